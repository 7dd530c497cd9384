"""Carrying the last known value forward along an ordered key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_of: Column,
    carried: dict[str, Column],
    include_current: bool = False,
) -> DataFrame:
    """Adds, per row, the last non-null value of each expression over earlier rows of the key.

    ``slice_of`` must not decrease along ``order``. A key is worked on slice by slice, so a
    hot key is spread over tasks: each slice is summed up to its last values (combined before
    the shuffle), the summaries are carried along the key, and rows look back within their
    slice, then to the summary. A carried value that may itself be null is wrapped in a struct.
    """
    rows = df.withColumn("_slice", slice_of)
    for name, value in carried.items():
        rows = rows.withColumn(f"_{name}", value)
    position = F.struct(*order)
    summary = rows.groupBy(*keys, "_slice").agg(
        *[
            F.max_by(F.col(f"_{name}"), F.when(F.col(f"_{name}").isNotNull(), position)).alias(f"_last_{name}")
            for name in carried
        ]
    )
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entry = summary.select(
        *keys, "_slice",
        *[F.last(f"_last_{name}", ignorenulls=True).over(along).alias(f"_entry_{name}") for name in carried],
    )
    end = 0 if include_current else -1
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    looked = rows
    for name in carried:
        looked = looked.withColumn(f"_own_{name}", F.last(f"_{name}", ignorenulls=True).over(inside))
    joined = looked.join(entry, [*keys, "_slice"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_own_{name}", f"_entry_{name}").alias(name) for name in carried],
    )
