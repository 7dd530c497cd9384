"""Rows that a join can meet, told by a bitmap of hashed keys before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, as a power of two: at most ``2**(BITS - 6)`` rows of two numbers, for any number of keys.
BITS = 22


def may_meet(rows: DataFrame, keys: list[Column], others: DataFrame, other_keys: list[Column]) -> DataFrame:
    """Those of ``rows`` whose keys may be among the other side's; the rest certainly aren't.

    It only spares work: a row that stays still has to be joined, by merge, as ``rows`` are meant to be too many for a broadcast. Keys are compared by their hash, so both sides need the same types. The
    bitmap is of bounded size and broadcast; the more keys the other side has, the more rows stay.
    """
    at = F.pmod(F.xxhash64(*other_keys), F.lit(1 << BITS))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_mask")
    bitmap = others.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(mask)
    hit = (F.shiftright("_at", 6) == F.col("_word")) & (F.expr("shiftright(_mask, cast(_at & 63 as int)) & 1") == 1)
    return rows.withColumn("_at", F.pmod(F.xxhash64(*keys), F.lit(1 << BITS))).join(F.broadcast(bitmap), hit, "left_semi").drop("_at").hint("merge")
