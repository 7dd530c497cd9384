"""Stop-day and stop-hour reliability tables from arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.functions.calendar import LOCAL_OFFSET_HOURS, local_hour
from stopclock.functions.numbers import half_up, index_percentile, median
from stopclock.operators.quantiles import rounded_quantiles
from stopclock.operators.traces import with_previous

# Fixed values
ON_TIME_S = (-60, 300)
HEADWAY_S = (60.0, 3600.0)
MIN_HEADWAYS = 3

HEADWAY_HORIZON_MS = 3_600_000
HEADWAY_SLICE_MS = 7_200_000

STOP_KEYS = ["service_date", "stop_id", "route_id", "direction"]
DAILY_COLUMNS = [
    "date", "stop_id", "route_id", "direction", "n_obs", "n_matched", "on_time", "late", "early",
    "delay_med_s", "delay_p90_s", "headway_med_s", "headway_sched_s", "ewt_s",
]
HOURLY_COLUMNS = [
    "date", "stop_id", "route_id", "direction", "hour", "n_obs", "n_matched", "on_time", "late", "early",
    "delay_med_s",
]


def punctuality_counts() -> list[Column]:
    """Observed, matched, on-time, late and early arrivals; unmatched ones are in none of the last three."""
    delay = F.col("delay_s")
    low, high = ON_TIME_S
    return [
        F.count("*").cast("int").alias("n_obs"),
        F.count(delay).cast("int").alias("n_matched"),
        F.count_if(delay.between(low, high)).cast("int").alias("on_time"),
        F.count_if(delay > high).cast("int").alias("late"),
        F.count_if(delay < low).cast("int").alias("early"),
    ]


def observed_headways(arrivals: DataFrame) -> DataFrame:
    """Seconds since the previous arrival of the same stop, route and direction that day.

    Vehicles and pattern suffixes are mixed. Only gaps strictly between one minute and one
    hour count, so the search for the previous arrival looks back one hour.
    """
    spaced = with_previous(
        arrivals.select(*STOP_KEYS, "ts_ms"), STOP_KEYS, ["ts_ms"], ["ts_ms"], HEADWAY_HORIZON_MS, HEADWAY_SLICE_MS
    )
    headway = (F.col("ts_ms") - F.col("prev.ts_ms")) / 1000.0
    return (
        spaced.withColumn("headway_s", headway)
        .where((F.col("headway_s") > HEADWAY_S[0]) & (F.col("headway_s") < HEADWAY_S[1]))
        .select(*STOP_KEYS, "ts_ms", "headway_s")
    )


def headway_stats(headways: DataFrame) -> DataFrame:
    """Per stop-day: number of headways, rounded median and the expected wait they cause."""
    stats = rounded_quantiles(
        _headway_histogram(headways), STOP_KEYS, 0, "headway_med_s", sums=["total", "squares"]
    )
    n = F.col("n")
    wait = F.when(n >= MIN_HEADWAYS, F.col("squares") / (2.0 * (F.col("total") / n) * n))
    return stats.select(
        *STOP_KEYS, n.alias("n_headways"), F.col("headway_med_s").cast("int").alias("headway_med_s"),
        wait.alias("wait_s"),
    )


def _headway_histogram(headways: DataFrame) -> DataFrame:
    """Whole-second buckets of headways that also carry their sum and sum of squares."""
    bucket = F.floor(F.col("headway_s") + 0.5)
    h = F.col("headway_s")
    return headways.groupBy(*STOP_KEYS, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min(h).alias("low"), F.max(h).alias("high"),
        F.sum(h).alias("total"), F.sum(h * h).alias("squares"),
    )


def excess_wait(wait: Column, scheduled_headway: Column) -> Column:
    """Expected wait beyond half the scheduled headway, never below zero; null if either is missing."""
    excess = wait - scheduled_headway / 2.0
    return F.when(excess.isNotNull(), half_up(F.greatest(F.lit(0.0), excess)).cast("int"))


def stop_daily(arrivals: DataFrame, scheduled: DataFrame) -> DataFrame:
    """The stop-day table. ``scheduled``: service_date, route_id, direction, stop_id, headway_sched_s."""
    delays = arrivals.groupBy(*STOP_KEYS).agg(
        *punctuality_counts(),
        half_up(median("delay_s")).cast("int").alias("delay_med_s"),
        index_percentile("delay_s", 0.9).cast("int").alias("delay_p90_s"),
    )
    headways = headway_stats(observed_headways(arrivals))
    planned = scheduled.select(*STOP_KEYS, "headway_sched_s")
    return (
        delays.join(headways, STOP_KEYS, "left")
        .join(planned.withColumnRenamed("headway_sched_s", "planned_s"), STOP_KEYS, "left")
        .withColumn("ewt_s", excess_wait(F.col("wait_s"), F.col("planned_s")))
        .withColumn("headway_sched_s", half_up(F.col("planned_s")).cast("int"))
        .withColumnRenamed("service_date", "date")
        .select(*DAILY_COLUMNS)
    )


def stop_hourly(arrivals: DataFrame, offset_hours: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """The stop-hour table, by local hour of arrival."""
    return (
        arrivals.withColumn("hour", local_hour(F.col("ts_ms"), offset_hours))
        .groupBy(*STOP_KEYS, "hour")
        .agg(*punctuality_counts(), half_up(median("delay_s")).cast("int").alias("delay_med_s"))
        .withColumnRenamed("service_date", "date")
        .select(*HOURLY_COLUMNS)
    )
