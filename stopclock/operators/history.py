"""History queries over the stop-day and stop-hour tables, and the area report."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stopclock.functions.calendar import in_band, matches_day_type
from stopclock.functions.numbers import median
from stopclock.session import hadoop_path, scratch_root

# Fixed values
GRADES = ((0.8, "A"), (0.7, "B"), (0.6, "C"), (0.5, "D"), (0.4, "E"))
LOWEST_GRADE = "F"
MIN_MATCHED = 30

Day = str | dt.date
Stops = list[str] | DataFrame

_COUNTS = ["n_obs", "n_matched", "on_time", "late", "early"]
_WEIGHT = "CAST(nvl2(ewt_s, n_obs, NULL) AS BIGINT)"
#: What the statistics of a stop are, as SQL aggregates; the SQL functions use the same.
DAILY_MEASURES = {c: f"sum({c})" for c in _COUNTS} | {
    "delay_med_s": "percentile(delay_med_s, 0.5)",
    "delay_p90_s": "percentile(delay_p90_s, 0.5)",
    "ewt_s": f"CAST(sum(ewt_s * {_WEIGHT}) AS DOUBLE) / nullif(sum({_WEIGHT}), 0)",
    "headway_med_s": "percentile(headway_med_s, 0.5)",
}
HOURLY_MEASURES = DAILY_MEASURES | {c: "CAST(NULL AS DOUBLE)" for c in ("delay_p90_s", "ewt_s", "headway_med_s")}
PROFILE_MEASURES = {c: DAILY_MEASURES[c] for c in ("n_matched", "on_time", "late", "delay_med_s")}
COVERAGE = {"first_date": "min(date)", "last_date": "max(date)", "days": "count(*)"}


def _measured(measures: dict[str, str]) -> list[Column]:
    return [F.expr(value).alias(name) for name, value in measures.items()]


def _chosen(table: DataFrame, stops: Stops, start: Day, end: Day, day_type: str | None) -> DataFrame:
    """Rows of a stop set in an inclusive date range. The date filter prunes partitions.

    A short stop list becomes a pushed-down filter; a table of stops becomes a semi-join.
    """
    dated = table.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    dated = dated.where(matches_day_type(F.col("date"), day_type))
    if isinstance(stops, DataFrame):
        return dated.join(stops.select("stop_id"), "stop_id", "left_semi")
    return dated.where(F.col("stop_id").isin(*stops)) if stops else dated.where(F.lit(False))


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def history_stats(
    daily: DataFrame,
    hourly: DataFrame,
    stops: Stops,
    start: Day,
    end: Day,
    day_type: str | None = "all",
    band: str | None = "all",
) -> DataFrame:
    """One row per stop. Band ``all`` reads the daily table, any other band the hourly one.

    Medians are taken over table rows, unweighted; excess wait is weighted by observations.
    Headway, p90 and excess wait exist for ``all`` only. A null band gives no rows, an unknown
    one every hour of the hourly table.
    """
    if band == "all":
        return _chosen(daily, stops, start, end, day_type).groupBy("stop_id").agg(*_measured(DAILY_MEASURES))
    chosen = _chosen(hourly, stops, start, end, day_type)
    chosen = chosen.where(F.lit(False) if band is None else in_band(F.col("hour"), band))
    return chosen.groupBy("stop_id").agg(*_measured(HOURLY_MEASURES))


def history_hourly(
    hourly: DataFrame, stops: Stops, start: Day, end: Day, day_type: str | None = "all"
) -> DataFrame:
    """Delay profile by local hour over a stop set, in hour order."""
    return _chosen(hourly, stops, start, end, day_type).groupBy("hour").agg(*_measured(PROFILE_MEASURES)).orderBy("hour")


def history_coverage(ledger: DataFrame) -> DataFrame:
    """First and last derived day and their number; one row even for an empty ledger."""
    return ledger.agg(*_measured(COVERAGE))


def area_reliability(stats: DataFrame) -> DataFrame:
    """On-time share of an area and its grade, from :func:`history_stats` rows.

    Each stop's on-time share is weighted by its number of observations. Stops without a
    matched arrival have no share and no weight. The "within schedule" window is the on-time
    window of the counts, one minute early to five minutes late.
    """
    share = F.col("on_time") / F.nullif(F.col("n_matched"), F.lit(0))
    weight = F.when(share.isNotNull(), F.col("n_obs"))
    score = F.sum(share * weight) / F.nullif(F.sum(weight), F.lit(0))
    return stats.agg(
        F.count("*").alias("stops"), F.sum("n_obs").alias("n_obs"), score.alias("score")
    ).withColumn("grade", grade(F.col("score")))


def grade(score: Column) -> Column:
    label = F.lit(LOWEST_GRADE)
    for floor, name in reversed(GRADES):
        label = F.when(score >= floor, name).otherwise(label)
    return F.when(score.isNotNull(), label)


def area_medians(daily: DataFrame, stops: Stops, start: Day, end: Day, day_type: str | None = "all") -> DataFrame:
    """Median of the daily median delays over an area's stops, and likewise of p90 and headway."""
    return _chosen(daily, stops, start, end, day_type).agg(
        median("delay_med_s").alias("delay_med_s"),
        median("delay_p90_s").alias("delay_p90_s"),
        median("headway_med_s").alias("headway_med_s"),
    )


def stop_measures(stats: DataFrame) -> DataFrame:
    """Map-colouring measures; stops with fewer than 30 matched arrivals are marked insufficient."""
    enough = F.col("n_matched") >= MIN_MATCHED
    matched = F.nullif(F.col("n_matched"), F.lit(0))

    def shown(value: Column) -> Column:
        return F.when(enough, value)

    return stats.select(
        "stop_id", "n_obs", "n_matched",
        shown(F.col("on_time") / matched).alias("on_time_share"),
        shown(F.col("late") / matched).alias("late_share"),
        shown(F.col("delay_med_s")).alias("delay_med_s"),
        shown(F.col("headway_med_s")).alias("headway_med_s"),
        (~enough).alias("insufficient"),
    )


def worst_stops(stats: DataFrame, k: int | None = None) -> DataFrame:
    """Stops with enough data and their rank from least to most reliable, or the first ``k`` of them.

    With ``k`` the sort keeps ``k`` rows only; without, all stops are ranked by :func:`global_rank`.
    """
    measured = stop_measures(stats).where(~F.col("insufficient")).select("stop_id", "n_matched", "on_time_share")
    order = ["on_time_share", "stop_id"]
    if k is None:
        return global_rank(measured, order, "rank").orderBy("rank")
    return measured.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place from 1 of every row in a total order, without sorting all rows in one task.

    Rows are range-partitioned and sorted in their ranges; a range begins where the earlier ones end, which takes one number per
    range. The sorted rows are staged in the shared folder, where the result reads them, until the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stopclock/rank-{uuid.uuid4().hex}"
    folder, fs = hadoop_path(spark, path)
    # The id holds the range's number above 33 bits, and below them the row's place in it.
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    fs.deleteOnExit(folder)
    columns = df.columns
    placed = spark.read.schema(StructType([*df.schema, StructField("_at", LongType())])).parquet(path).withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1))
    starts, total = [], 0
    for r in sorted(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["_range"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "_r long, _start long")
    return placed.join(offsets, F.col("_range") == F.col("_r")).select(*columns, F.coalesce((F.col("_start") + F.col("_place") + 1).cast("int"), F.lit(0)).alias(name))


def route_measures(daily: DataFrame, stops: Stops, start: Day, end: Day, day_type: str | None = "all") -> DataFrame:
    """Per route: counts, on-time share and average observations per observed day."""
    matched = F.nullif(F.sum("n_matched"), F.lit(0))
    return (
        _chosen(daily, stops, start, end, day_type)
        .groupBy("route_id", "date")
        .agg(*_sums(_COUNTS))
        .groupBy("route_id")
        .agg(
            *_sums(_COUNTS),
            F.count("*").alias("days"),
            (F.sum("on_time") / matched).alias("on_time_share"),
            (F.sum("n_obs") / F.count("*")).alias("obs_per_day"),
        )
    )


def worst_route(measures: DataFrame) -> DataFrame:
    """The route with the lowest on-time share, the first by name on ties."""
    return measures.where(F.col("on_time_share").isNotNull()).orderBy("on_time_share", "route_id").limit(1)


def area_report(
    daily: DataFrame, hourly: DataFrame, stops: Stops, start: Day, end: Day,
    day_type: str | None = "all", band: str | None = "all", k: int | None = None,
) -> dict[str, DataFrame]:
    """The data behind an area's report, one table per panel."""
    stats = history_stats(daily, hourly, stops, start, end, day_type, band)
    routes = route_measures(daily, stops, start, end, day_type)
    return {
        "score": area_reliability(stats),
        "medians": area_medians(daily, stops, start, end, day_type),
        "stops": stop_measures(stats),
        "worst_stops": worst_stops(stats, k),
        "routes": routes,
        "worst_route": worst_route(routes),
        "by_hour": history_hourly(hourly, stops, start, end, day_type),
    }
