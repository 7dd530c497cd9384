"""Stop arrivals from changes of a vehicle's next stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.functions.calendar import LOCAL_OFFSET_HOURS, service_seconds
from stopclock.functions.geo import haversine_m
from stopclock.functions.numbers import half_up
from stopclock.operators.network import Network

# Fixed values
MIN_LEG_M = 20.0
UNPLACED_LEG = 1.0
MATCH_WINDOW_S = 1200

ARRIVAL_COLUMNS = ["service_date", "route_id", "direction", "stop_id", "ts_ms", "delay_s"]


def _last_index(stop_ids: Column, stop: Column) -> Column:
    """Zero-based last place of a stop in the travel order; null when absent."""
    place = F.array_position(F.reverse(stop_ids), stop)
    return F.when(place > 0, F.size(stop_ids) - place).cast("int")


def stop_changes(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs whose next stop moved forward along the direction, with the stops passed.

    Passed stops run from the old next stop up to, but not including, the new one.
    """
    moved = pairs.where(F.col("a_next_stop_id") != F.col("b_next_stop_id"))
    placed = (
        moved.join(sequences, "model_id", "inner")
        .withColumn("from_idx", _last_index(F.col("stops.stop_id"), F.col("a_next_stop_id")))
        .withColumn("to_idx", _last_index(F.col("stops.stop_id"), F.col("b_next_stop_id")))
        .where(F.col("to_idx") > F.col("from_idx"))
    )
    return placed.withColumn(
        "passed", F.slice("stops", F.col("from_idx") + 1, F.col("to_idx") - F.col("from_idx"))
    ).drop("stops", "from_idx", "to_idx")


def _walk(passed: Column, lat: Column, lon: Column) -> Column:
    """Running distance over the passed stops, starting from the earlier fix.

    A stop without coordinates counts as a leg of 1 and leaves the last point unchanged;
    every other leg is at least 20 m.
    """
    start = F.struct(
        lat.alias("lat"), lon.alias("lon"), F.lit(0.0).alias("run"),
        F.array().cast("array<struct<stop_id:string,run:double>>").alias("marks"),
    )

    def step(state: Column, stop: Column) -> Column:
        known = stop["lat"].isNotNull() & stop["lon"].isNotNull()
        leg = F.when(
            known,
            F.greatest(F.lit(MIN_LEG_M), haversine_m(state["lat"], state["lon"], stop["lat"], stop["lon"])),
        ).otherwise(F.lit(UNPLACED_LEG))
        run = state["run"] + leg
        return F.struct(
            F.when(known, stop["lat"]).otherwise(state["lat"]).alias("lat"),
            F.when(known, stop["lon"]).otherwise(state["lon"]).alias("lon"),
            run.alias("run"),
            F.concat(state["marks"], F.array(F.struct(stop["stop_id"].alias("stop_id"), run.alias("run")))).alias("marks"),
        )

    return F.aggregate(passed, start, step)


def interpolate_arrivals(changes: DataFrame) -> DataFrame:
    """One row per passed stop, its time shared out by distance between the two fixes."""
    walked = changes.withColumn("walk", _walk(F.col("passed"), F.col("a_lat"), F.col("a_lon")))
    last_leg = F.greatest(
        F.lit(MIN_LEG_M),
        haversine_m(F.col("walk.lat"), F.col("walk.lon"), F.col("b_lat"), F.col("b_lon")),
    )
    return (
        walked.select(
            "service_date", "route_id", "direction", "model_id", "a_ts_ms", "dt_ms",
            (F.col("walk.run") + last_leg).alias("total"),
            F.explode("walk.marks").alias("mark"),
        )
        .select(
            "service_date", "route_id", "direction", "model_id",
            F.col("mark.stop_id").alias("stop_id"),
            (F.col("a_ts_ms") + F.col("dt_ms") * (F.col("mark.run") / F.col("total"))).alias("ts_ms"),
        )
    )


def _within_reach(timetable: DataFrame) -> DataFrame:
    """``model_id, stop_id, span, entries``: for each span of ``MATCH_WINDOW_S`` seconds the timetable entries that an arrival in it can match.

    Those are the entries of the span and of its two neighbours, each time once, with its first place in the list. A list is cut into
    spans within its row, so one shuffle moves a span's entries together.
    """
    own = lambda e: F.floor(e["entry"] / MATCH_WINDOW_S)
    places = F.transform("times", lambda t, i: F.struct(t.alias("entry"), i.alias("pos")))
    listed = timetable.select("model_id", "stop_id", F.filter(places, lambda e: e["entry"].isNotNull()).alias("all"))
    spans = F.array_distinct(F.flatten(F.transform("all", lambda e: F.sequence(own(e) - 1, own(e) + 1))))
    spread = listed.select("model_id", "stop_id", "all", F.explode(spans).alias("span")).select(
        "model_id", "stop_id", "span", F.filter("all", lambda e: F.abs(own(e) - F.col("span")) <= 1).alias("some")
    )
    met = spread.groupBy("model_id", "stop_id", "span").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("sorted"))
    first = F.filter("sorted", lambda e, i: (i == 0) | (F.get(F.col("sorted"), i - 1)["entry"] != e["entry"]))
    return met.select("model_id", "stop_id", "span", first.alias("entries"))


def match_schedule(
    arrivals: DataFrame, timetable: DataFrame, offset_hours: int = LOCAL_OFFSET_HOURS
) -> DataFrame:
    """Signed delay against the nearest timetable entry within 20 minutes, else null.

    Equally near entries go to the one listed first. The match is not one-to-one. An arrival looks at the entries of its own
    and the neighbouring time spans only, however long the timetable is.
    """
    at = service_seconds(F.col("ts_ms"), F.col("service_date"), offset_hours)
    nearest = F.array_min(
        F.transform("entries", lambda e: F.struct(F.abs(F.col("at_s") - e["entry"]).alias("off"), e["pos"].alias("pos"), e["entry"].alias("entry")))
    )
    return (
        arrivals.withColumn("at_s", at)
        .withColumn("span", F.floor(F.col("at_s") / MATCH_WINDOW_S))
        .join(_within_reach(timetable), ["model_id", "stop_id", "span"], "left")
        .withColumn("nearest", nearest)
        .withColumn(
            "delay_s",
            F.when(F.col("nearest.off") <= MATCH_WINDOW_S, half_up(F.col("at_s") - F.col("nearest.entry")).cast("int")),
        )
        .select(*ARRIVAL_COLUMNS)
    )


def derive_arrivals(pairs: DataFrame, network: Network, offset_hours: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """Arrivals of all pairs: service_date, route_id, direction, stop_id, ts_ms, delay_s."""
    changes = stop_changes(pairs, network.sequences)
    return match_schedule(interpolate_arrivals(changes), network.timetable, offset_hours)
