"""Medians and percentiles of real-valued columns, exact after rounding.

A group's values are first counted in buckets one rounding step wide, with the smallest and
largest value of each bucket. Buckets are combined before the shuffle, and their number is
bounded by the value range, however many rows a group has. The counts add up across days,
so stored histograms merge into weekly ones.

Any order statistic falls in a known bucket, so its rounded value is known. The mean of the two
middle values needs them only when they lie in different buckets, and then they are the first
bucket's largest and the second's smallest value. The results are therefore exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopclock.functions.numbers import half_up


def histogram(df: DataFrame, keys: list[str], value: str, decimals: int) -> DataFrame:
    """Rows ``keys, bucket, n, low, high``; a bucket holds the values rounding to it."""
    bucket = F.floor(F.col(value) * float(10**decimals) + 0.5)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    )


def merge_histograms(hist: DataFrame, keys: list[str]) -> DataFrame:
    return hist.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def rounded_quantiles(
    hist: DataFrame,
    keys: list[str],
    decimals: int,
    median: str,
    percentiles: dict[str, float] | None = None,
    sums: list[str] | None = None,
) -> DataFrame:
    """One row per key: ``n``, the rounded median and the rounded index percentiles.

    ``sums`` names further histogram columns to add up per key.
    """
    scale = float(10**decimals)
    group = Window.partitionBy(*keys)
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("_upto", F.sum("n").over(running)).withColumn("_total", F.sum("n").over(group))

    def first_past(rank, column: str):
        return F.min(F.when(F.col("_upto") > rank, F.col(column)))

    lower = F.floor((F.col("_total") - 1) / 2)
    upper = F.floor(F.col("_total") / 2)
    picks = {
        name: first_past(F.least(F.col("_total") - 1, F.floor(F.lit(p) * F.col("_total"))), "bucket")
        for name, p in (percentiles or {}).items()
    }
    grouped = ranked.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        first_past(lower, "bucket").alias("lower_bucket"),
        first_past(lower, "high").alias("lower_value"),
        first_past(upper, "bucket").alias("upper_bucket"),
        first_past(upper, "low").alias("upper_value"),
        *[pick.alias(name) for name, pick in picks.items()],
        *[F.sum(name).alias(name) for name in sums or []],
    )
    middle = F.when(
        F.col("lower_bucket") == F.col("upper_bucket"), F.col("lower_bucket") / scale
    ).otherwise(half_up((F.col("lower_value") + F.col("upper_value")) / 2.0, decimals))
    return grouped.select(
        *keys, "n", middle.alias(median),
        *[(F.col(name) / scale).alias(name) for name in picks],
        *(sums or []),
    )
