"""Exact deduplication by skew-safe combining, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, own_names, plain_names


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical, null counting as empty. Of equal texts the row with the largest id stays.
    Rows are combined three times, each time by digest and full text: inside each map task before anything
    moves, then per salt, then over the salts. A group of any size so reaches one task as at most ``salts`` rows.
    Two texts of one SHA-256 would stay two groups, and the lookup of the winners would stop with an error.

    Rows with equal text and equal id (repeated rows) share one decision. Null ids count as the smallest; where
    all ids of a group are null, ``keep_id`` is null and its rows are kept. Texts of any length are compared whole. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text_sha256"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    salted = (
        rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("text_sha256", "_text", "_salt")
        .agg(F.max("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    )
    whole = salted.groupBy("text_sha256", "_text").agg(F.max("_id").alias("_id"), F.sum("_n").alias("_n"))
    # A written table: a join of two plain inputs, so a digest that many rows have can be split.
    winners = whole.groupBy(F.col("text_sha256").alias("_digest")).agg(
        F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("_texts")
    )
    winners = checkpointed(winners)
    clash = F.raise_error(F.lit("two texts with one SHA-256 digest"))
    return (
        rows.drop("_text")
        .join(winners, F.col("text_sha256") == F.col("_digest"))
        .select(
            "doc_id",
            "keep_id",
            F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(clash.cast("long")).alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns; repeated rows all stay where their id wins."""
    decided = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    own_id, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    digest = F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
    kept = plain_names(docs).join(decided, own_id.cast("long").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_semi")
    return own_names(kept, docs.columns)
