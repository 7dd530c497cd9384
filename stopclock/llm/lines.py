"""Line deduplication by the number of distinct sites a line is spread over, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, id_back, id_of, key_bits, split_by_bits

#: Sketches with 2**LG_K registers err by about 1.04 / sqrt(2**LG_K): 1.6 percent.
LG_K = 12
#: Estimates within this part of the threshold are counted exactly; that is fifteen times the error.
NEAR = 0.25


def _key(line: Column) -> Column:
    """The digest of a line without outer blanks; null for a blank line, which is never removed."""
    plain = F.trim(line, F.lit(" \t\r"))
    return F.when(plain != "", F.md5(plain))


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """Of rows ``key, site`` the keys on ``sites`` distinct sites or more.

    Keys with fewer rows than that can't have so many sites and go first; their counts are combined before the
    shuffle. For the rest sketches of the sites are merged. Estimates near the threshold are
    replaced by exact counts of distinct pairs, so no decision rests on a sketch's error.
    """
    often = checkpointed(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select(F.col("key").alias("k")))
    frequent = lines.join(often, F.col("key") == F.col("k"), "left_semi")
    spread = checkpointed(frequent.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about")))
    low, high = sites * (1 - NEAR), sites * (1 + NEAR)
    near = spread.where(F.col("about").between(low, high)).select(F.col("key").alias("k"))
    counted = (
        frequent.join(near, F.col("key") == F.col("k"), "left_semi")
        .groupBy("key", "site").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("exact"))
        .where(F.col("exact") >= sites).select("key")
    )
    return spread.where(F.col("about") > high).select("key").union(counted)


def clean_lines(docs: DataFrame, sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``doc_id, n_lines, n_removed, text``: every row without the lines that stand on ``sites`` distinct sites or more.

    Lines are split at line feeds and compared without outer blanks; blank lines always stay, and kept lines are returned as
    they were. Texts that hold no such line never move. Null texts count as empty and have no lines; a null site is a
    site of its own; null ids are ordinary; repeated rows are treated alike; a text is taken apart whole, however long; an empty table gives no rows.
    """
    rows = docs.select(
        id_of(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null")).alias("site"),
    ).withColumn("t", F.xxhash64("text"))
    lines = rows.select("d", "t", "site", F.explode(F.split("text", "\n")).alias("line")).select("d", "t", "site", _key(F.col("line")).alias("key")).where("key is not null")
    common = checkpointed(boilerplate(lines.select("key", "site"), sites).select(F.col("key").alias("k")))
    # A text has few distinct boilerplate lines, whatever its length.
    found = checkpointed(
        lines.select("d", "t", "key").join(common, F.col("key") == F.col("k")).groupBy("d", "t").agg(F.collect_set("key").alias("gone")).select(F.col("d").alias("fd"), F.col("t").alias("ft"), "gone")
    )
    some, others = split_by_bits(rows, ["d", "t"], key_bits(found, ["fd", "ft"]))
    hit = some.join(found, (F.col("d") == F.col("fd")) & (F.col("t") == F.col("ft")), "left").select("d", "text", "gone")
    every = hit.union(others.select("d", "text", F.lit(None).cast("array<string>")))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    stays = lambda line: ~F.coalesce(F.array_contains("gone", _key(line)), F.lit(False))
    kept = F.when(F.col("gone").isNull(), F.split("text", "\n")).otherwise(F.filter(F.split("text", "\n"), stays))
    return every.select(id_back(F.col("d")).alias("doc_id"), n_lines.alias("n_lines"), kept.alias("kept")).select(
        "doc_id", "n_lines", F.when(F.col("n_lines") == 0, F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("text")
    )


def line_report(docs: DataFrame, sites: int = 10) -> DataFrame:
    return clean_lines(docs, sites).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
