"""Network models from dated snapshots.

A model is one direction of one route under one timetable block. Service days point to models,
so a long archive repeats only the small day-to-model table, never the models.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.functions.calendar import clock_list_seconds
from stopclock.functions.geo import polyline_vertices, squared_degrees
from stopclock.operators.carry import carry_forward
from stopclock.session import Staging, joins_in_place

FORWARD, REVERSE = 1, 0

# Side of a lookup cell in degrees. Any size gives the same results.
CELL_DEG = 0.0005
# Edges longer than so many cells (about 20 km) get no cells of their own: such a line most likely has a
# misplaced vertex, and samples there look at the whole line instead.
LONGEST_EDGE = 400


@dataclass(frozen=True)
class Network:
    """The tables the derivation joins with.

    patterns:  service_date, route_id, pattern_suffix, direction, model_id
    sequences: model_id, stops array<struct<stop_id, lat, lon>> in travel order
    timetable: model_id, stop_id, times array<int> in list order, headway_sched_s
    vertices:  model_id, idx, lat, lon, cum_m
    cells:     model_id, cell_x, cell_y, near array<struct<idx, lat, lon, cum_m>>
    """

    patterns: DataFrame
    sequences: DataFrame
    timetable: DataFrame
    vertices: DataFrame
    cells: DataFrame
    # The size the cells were built with.
    cell_deg: float = CELL_DEG
    # Names of staged tables that are joined by merge.
    large: frozenset[str] = frozenset()

    def staged(self, staging: Staging) -> "Network":
        """The same tables written to the shared folder, so that their sizes are known.

        A timetable is joined by time spans, a row each, of which every entry is in three. Cells and the vertices they meet are many
        times what the lines take, and lie by model already: they are joined there and aren't shuffled.
        """
        tables = {f.name: table for f in fields(self) if isinstance(table := getattr(self, f.name), DataFrame)}
        grown = {"timetable": 16}
        with joins_in_place(self.cells.sparkSession):
            staged = {"cells": staging.stage_sized(tables.pop("cells"), "cells")}
        staged |= {k: staging.stage_sized(v, k, grown.get(k, 1)) for k, v in tables.items()}
        return replace(self, **staged, large=frozenset(staging.large & staged.keys()))


def snapshot_for_days(days: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Newest snapshot on or before each service day; days before the first are dropped.

    Both inputs are merged into one ordering of days and the last snapshot is carried
    forward month by month, so the work is linear in days and nothing is paired.
    """
    d = days.select("service_date").distinct()
    s = snapshots.select("snapshot_date").distinct()
    marks = d.select(F.col("service_date").alias("day"), F.lit(None).cast("date").alias("snap"), F.lit(True).alias("asked")).unionByName(
        s.select(F.col("snapshot_date").alias("day"), F.col("snapshot_date").alias("snap"), F.lit(False).alias("asked"))
    )
    filled = carry_forward(
        marks.withColumn("all", F.lit(0)),
        keys=["all"],
        order=["day", "asked"],
        slice_of=F.trunc("day", "month"),
        carried={"snapshot_date": F.col("snap")},
        include_current=True,
    )
    return filled.where(F.col("asked") & F.col("snapshot_date").isNotNull()).select(
        F.col("day").alias("service_date"), "snapshot_date"
    )


def last_per_key(df: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    """Later list entries replace earlier ones with the same key."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.col(position)).alias("last"))
        .select(*keys, "last.*")
    )


def _sequence_times(times: Column) -> Column:
    """Differences of neighbouring timetable entries, in list order."""
    return F.transform(
        F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))),
        lambda t, i: t - F.get(times, i),
    )


def timetable_headways(timetable: DataFrame) -> DataFrame:
    """Adds ``headway_sched_s``: median of the successive differences, more than one entry needed."""
    gaps = F.sort_array(_sequence_times(F.col("times")))
    n = F.size(gaps)
    low = F.get(gaps, F.floor((n - 1) / 2).cast("int"))
    high = F.get(gaps, F.floor(n / 2).cast("int"))
    return timetable.withColumn("headway_sched_s", F.when(n > 0, (low + high) / 2.0))


def _touched_cells(vertices: DataFrame, cell_deg: float) -> DataFrame:
    """``model_id, x, y, bound``: cells met when walking along the line in steps no longer than a cell; of very long edges only the ends' cells.

    ``bound`` is no less than the distance from a point of the cell to the nearest end of an edge that the cell lies on.
    """
    ahead = Window.partitionBy("model_id").orderBy("idx")
    d_lat = F.coalesce(F.lead("lat").over(ahead) - F.col("lat"), F.lit(0.0))
    d_lon = F.coalesce(F.lead("lon").over(ahead) - F.col("lon"), F.lit(0.0))
    edges = vertices.select("model_id", "lat", "lon", d_lat.alias("d_lat"), d_lon.alias("d_lon"))
    steps = F.ceil(F.greatest(F.abs("d_lat"), F.abs("d_lon")) / cell_deg) + 1
    stops = F.when(F.col("steps") <= LONGEST_EDGE, F.sequence(F.lit(0).cast("long"), F.col("steps"))).otherwise(
        F.array(F.lit(0).cast("long"), F.col("steps"))
    )
    walked = edges.withColumn("steps", steps.cast("long")).select("*", F.explode(stops).alias("k"))
    share = F.col("k") / F.col("steps")
    length = F.sqrt(F.col("d_lat") * F.col("d_lat") + F.col("d_lon") * F.col("d_lon"))
    return walked.select(
        "model_id",
        F.floor((F.col("lon") + F.col("d_lon") * share) / cell_deg).alias("x"),
        F.floor((F.col("lat") + F.col("d_lat") * share) / cell_deg).alias("y"),
        (length * F.least(share, 1 - share)).alias("bound"),
    ).groupBy("model_id", "x", "y").agg(F.min("bound").alias("bound"))


def lookup_cells(vertices: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """For cells along a line: every vertex that can be nearest to some point of the cell.

    With the centre's nearest vertex at distance ``d``, no vertex further than ``d`` plus the
    cell's diagonal can be nearest to a point inside, so dropping those loses nothing. How far ``d`` can be is known
    from the walk along the edges; vertices are looked for in squares at least so wide around the cell, of sides that
    are powers of two of a cell's. A cell so meets the vertices near it, not its whole line.
    """
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])

    def beside(df: DataFrame, x: str, y: str) -> DataFrame:
        """Every row in the nine squares around its own."""
        rest = [c for c in df.columns if c not in (x, y)]
        wide = df.select(*rest, y, F.explode(F.transform(around, lambda d: F.col(x) + d)).alias(x))
        return wide.select(*rest, x, F.explode(F.transform(around, lambda d: F.col(y) + d)).alias(y))

    cells = beside(_touched_cells(vertices, cell_deg), "x", "y").groupBy("model_id", "x", "y").agg(F.min("bound").alias("bound"))
    reach = cell_deg * 2**0.5 + 1e-9
    # A neighbour's centre is up to two diagonals and a half from the point of the walk.
    radius = F.col("bound") + 2.5 * reach + reach
    level = F.greatest(F.lit(0), F.ceil(F.log2(radius / cell_deg))).cast("int")
    side = F.pow(F.lit(2.0), F.col("level"))
    leveled = cells.withColumn("level", level).withColumn("sx", F.floor(F.col("x") / side)).withColumn("sy", F.floor(F.col("y") / side))
    wanted = beside(leveled, "sx", "sy")
    # Cells are many times what the lines take that the planner knows the size of: nothing of them is broadcast.
    levels = leveled.select(F.col("model_id").alias("_model"), F.col("level").alias("_level")).distinct().hint("merge")
    squares = vertices.join(levels, F.col("model_id") == F.col("_model")).select(
        F.col("model_id").alias("_m"), F.col("_level").alias("_l"), F.struct("idx", "lat", "lon", "cum_m").alias("v"),
        F.floor(F.floor(F.col("lon") / cell_deg) / F.pow(F.lit(2.0), F.col("_level"))).alias("_sx"),
        F.floor(F.floor(F.col("lat") / cell_deg) / F.pow(F.lit(2.0), F.col("_level"))).alias("_sy"),
    )
    same = (F.col("model_id") == F.col("_m")) & (F.col("level") == F.col("_l")) & (F.col("sx") == F.col("_sx")) & (F.col("sy") == F.col("_sy"))
    distance = F.sqrt(squared_degrees(F.col("v.lat"), F.col("v.lon"), (F.col("y") + 0.5) * cell_deg, (F.col("x") + 0.5) * cell_deg))
    met = wanted.join(squares.hint("merge"), same).withColumn("d", distance).where(F.col("d") <= radius)
    found = met.groupBy("model_id", "x", "y").agg(F.min("d").alias("closest"), F.sort_array(F.collect_list(F.struct("v.idx", "v.lat", "v.lon", "v.cum_m", "d"))).alias("all"))
    near = F.transform(F.filter("all", lambda v: v["d"] <= F.col("closest") + reach), lambda v: F.struct(v["idx"].alias("idx"), v["lat"].alias("lat"), v["lon"].alias("lon"), v["cum_m"].alias("cum_m")))
    return found.select("model_id", F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), near.alias("near"))


def _pick_block(blocks: Column, day: Column) -> Column:
    """First timetable block listing the day, else the first block."""
    covering = F.filter(blocks, lambda b: F.array_contains(F.coalesce(b["serviceDates"], F.array().cast("array<string>")), day))
    return F.coalesce(F.get(covering, F.lit(0)), F.get(blocks, F.lit(0)))


def build_network(days: DataFrame, stops: DataFrame, routes: DataFrame) -> Network:
    """Models of every service day from snapshot rows.

    days:   service_date, snapshot_date
    stops:  snapshot_date, pos, id, lat, lon
    routes: snapshot_date, pos, id, patterns, sched_fwd, sched_rev, poly_fwd, poly_rev
    """
    routes = routes.withColumnRenamed("id", "route_id").withColumnRenamed("pos", "entry")
    stop_points = last_per_key(stops, ["snapshot_date", "id"], "pos", ["lat", "lon"]).withColumnRenamed("id", "stop_id")

    directed = routes.select(
        "snapshot_date", "route_id", "entry", "patterns",
        F.explode(F.array(
            F.struct(F.lit(FORWARD).alias("direction"), F.col("sched_fwd").alias("blocks"), F.col("poly_fwd").alias("encoded")),
            F.struct(F.lit(REVERSE).alias("direction"), F.col("sched_rev").alias("blocks"), F.col("poly_rev").alias("encoded")),
        )).alias("side"),
    ).select("snapshot_date", "route_id", "entry", "patterns", "side.*").where(F.size("blocks") > 0)

    # Which block serves which day, decided on the blocks' dates and end stops alone.
    outlines = directed.select(
        "snapshot_date", "route_id", "entry", "direction", "patterns",
        F.transform("blocks", lambda b, i: F.struct(
            i.alias("block"),
            b["serviceDates"].alias("serviceDates"),
            F.get(b["stops"], F.lit(0))["id"].alias("head"),
            F.try_element_at(b["stops"], F.lit(-1))["id"].alias("tail"),
        )).alias("blocks"),
    )
    dated = (
        days.join(outlines, "snapshot_date")
        .withColumn("chosen", _pick_block(F.col("blocks"), F.col("service_date").cast("string")))
        .select("service_date", "snapshot_date", "route_id", "entry", "direction", "patterns", "chosen.block", "chosen.head", "chosen.tail")
    )
    # A route listed twice is its last entry that has a matching pattern; one without any keeps its last entry.
    matching = F.coalesce(F.exists("patterns", lambda p: F.coalesce(_preference(p).isNotNull(), F.lit(False))), F.lit(False))
    entries = dated.select("service_date", "route_id", "entry", matching.alias("matching"))
    last = F.when(F.max("matching"), F.max(F.when(F.col("matching"), F.col("entry")))).otherwise(F.max("entry"))
    chosen = entries.groupBy("service_date", "route_id").agg(last.alias("entry"))
    # Routes are many times larger in memory than in their files, so the size of files must not make Spark broadcast them. The
    # narrow sides are hashed; the rows with timetables are neither sorted nor collected.
    dated = dated.join(chosen.hint("shuffle_hash"), ["service_date", "route_id", "entry"], "left_semi").withColumn(
        "model_id", F.concat_ws("|", F.col("snapshot_date").cast("string"), "route_id", F.col("direction").cast("string"), F.col("block").cast("string"))
    )
    used = dated.select("model_id", "snapshot_date", "route_id", "entry", "direction", "block").distinct()
    models = used.hint("shuffle_hash").join(
        directed.drop("patterns"), ["snapshot_date", "route_id", "entry", "direction"]
    ).select(
        "model_id", "snapshot_date", "encoded",
        F.coalesce(F.get("blocks", F.col("block"))["stops"], F.array().cast("array<struct<id:string,arrivalTimes:string>>")).alias("stops"),
    )
    # Stops and vertices grow from these rows afterwards, so the planner must not put partitions together by the rows' size.
    models = models.repartition(int(days.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model_id")

    return Network(
        patterns=_match_patterns(dated),
        sequences=_sequences(models, stop_points),
        timetable=_timetable(models),
        vertices=(vertices := polyline_vertices(models, ["model_id"], "encoded")),
        cells=lookup_cells(vertices),
    )


def _preference(pattern: Column) -> Column:
    """How well a pattern matches a direction's end stops: 0 best, null not at all."""
    return (
        F.when(pattern["firstStop"]["id"] == F.col("head"), F.lit(0))
        .when(pattern["lastStop"]["id"] == F.col("tail"), F.lit(2))
    ) + F.when(F.col("direction") == FORWARD, F.lit(0)).otherwise(F.lit(1))


def _match_patterns(dated: DataFrame) -> DataFrame:
    """Pattern to direction: by first stop forward, first stop reverse, last stop forward, last stop reverse."""
    ends = dated.select(
        "service_date", "route_id", "direction", "model_id", "head", "tail",
        F.posexplode("patterns").alias("pos", "pattern"),
    )
    ranked = ends.select(
        "service_date", "route_id", F.col("pattern.patternSuffix").alias("pattern_suffix"), "pos",
        "direction", "model_id", _preference(F.col("pattern")).alias("preference"),
    ).where(F.col("preference").isNotNull())
    # A suffix listed twice keeps its last matching entry.
    return (
        ranked.groupBy("service_date", "route_id", "pattern_suffix")
        .agg(F.min_by(F.struct("direction", "model_id"), F.struct(-F.col("pos"), F.col("preference"))).alias("m"))
        .select("service_date", "route_id", "pattern_suffix", "m.direction", "m.model_id")
    )


def _sequences(models: DataFrame, stop_points: DataFrame) -> DataFrame:
    placed = models.select("model_id", "snapshot_date", F.posexplode("stops").alias("idx", "stop")).select(
        "model_id", "snapshot_date", "idx", F.col("stop.id").alias("stop_id")
    )
    return (
        placed.join(stop_points, ["snapshot_date", "stop_id"], "left")
        .groupBy("model_id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "stop_id", "lat", "lon"))).alias("ordered"))
        .select("model_id", F.transform("ordered", lambda s: F.struct(s["stop_id"].alias("stop_id"), s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("stops"))
    )


def _timetable(models: DataFrame) -> DataFrame:
    listed = models.select("model_id", F.posexplode("stops").alias("idx", "stop")).select(
        "model_id", "idx", F.col("stop.id").alias("stop_id"), clock_list_seconds(F.col("stop.arrivalTimes")).alias("times")
    )
    return timetable_headways(last_per_key(listed, ["model_id", "stop_id"], "idx", ["times"]))


def scheduled_headways(network: Network) -> DataFrame:
    """service_date, route_id, direction, stop_id, headway_sched_s."""
    directions = network.patterns.select("service_date", "route_id", "direction", "model_id").distinct()
    return directions.join(
        network.timetable.where(F.col("headway_sched_s").isNotNull()).select("model_id", "stop_id", "headway_sched_s"),
        "model_id",
    ).drop("model_id")
