"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, numbered, own_names, plain_names


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """Longest processing time over ``(size, groups of that size)``, largest size first: how many of each size a shard gets.

    A group goes to the least-loaded shard, ties to the lowest number. Groups of one size are alike, so those of a size that surely fill every
    shard up to a common level are placed at once, and a heap places the rest one by one: a size costs time in the
    number of shards, whatever the number of its groups.
    """
    loads = [0] * shards
    for size, count in sizes:
        # Items lie at load, load + size, …; the least ``count`` of all shards are taken. Those below ``low`` surely are.
        low, high = min(loads), max(loads) + size * (count + 1)
        below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]  # noqa: B023, E731
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
        taken = below(low)
        heap = [(x + size * n, k) for k, (x, n) in enumerate(zip(loads, taken, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(taken)):
            load, k = heap[0]
            taken[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        loads = [x + size * n for x, n in zip(loads, taken, strict=True)]
        yield size, taken


def assign_shards(rows: DataFrame, group: Column, size: Column, shards: int = 8) -> DataFrame:
    """Adds ``shard`` (0 … shards-1) to rows with columns that start with ``c`` only: rows of one ``group`` share a shard, and the shards' sums of ``size`` are near equal.

    All groups, sorted by size, go to the least-loaded shard. Groups of one size are alike: the driver reads only the distinct
    sizes with their counts, largest first and a partition at a time, and says how many each shard gets; a group's number among
    those of its size then tells its shard. There are few distinct sizes, as their sum can't exceed all bytes. Sums differ by about the
    smallest group, unless one group alone is more than a fair share. Group sizes are summed before
    the shuffle, so a group of any number of rows is one row per map task. ``size`` must be above 0.
    """
    rows = rows.withColumn("_group", F.coalesce(F.sha2(group.cast("string"), 256), F.lit("null"))).withColumn("_size", size)
    groups = checkpointed(rows.groupBy("_group").agg(F.sum("_size").alias("_bytes")))
    sizes = groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_bytes"))
    placed = []
    for byte_count, taken in longest_first(((r["_bytes"], r["n"]) for r in sizes.toLocalIterator()), shards):
        ends, total = [], 0
        for n in taken:
            total += n
            ends.append(total)
        placed.append((byte_count, ends))
    table = rows.sparkSession.createDataFrame(placed, "_b long, _ends array<long>")
    of_group = (
        numbered(groups, ["_bytes"], ["_group"], "_nth")
        .join(table, F.col("_bytes") == F.col("_b"))
        .select(F.col("_group").alias("_g"), F.size(F.filter("_ends", lambda e: e <= F.col("_nth"))).alias("shard"))
    )
    # A written table: a join of two plain inputs, so a group that many rows have can be split.
    return rows.join(checkpointed(of_group), F.col("_group") == F.col("_g")).drop("_group", "_g", "_size")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; equal texts share a shard.

    ``size`` is the text's UTF-8 bytes plus one. The law is ``bytes``: shard sizes are near equal. ``slot`` numbers the
    rows of a shard from 0 without gaps. A null text has size 1 and CRC 0 and forms a group with other null texts.
    Null and repeated ids are ordinary rows. An empty table gives no rows. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("_digest"),
    )
    dealt = assign_shards(narrow, F.col("_digest"), F.col("size"), shards).drop("_digest")
    # Null ids have numbers of their own, so that no block of numbering is hot.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id"))
    return numbered(checkpointed(dealt.withColumn("_spread", spread)), ["shard"], ["_spread", "doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, files: int = 8) -> str:
    """Writes the documents with their columns under ``path/shard=k/`` in about ``files`` files per shard, and returns the folders' name.

    That is ``shard``, with underscores in front where the documents have such a column.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    own = {c: F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col)}
    text = own[text_col].cast("string")
    dealt = assign_shards(plain_names(docs), F.sha2(text, 256), F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, shards)
    spread = F.pmod(F.xxhash64(own[id_col], text), F.lit(files))
    columns = [*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("shard").alias(name)]
    dealt.repartition(shards * files, "shard", spread).select(*columns).write.partitionBy(name).mode("overwrite").parquet(path)
    return name
