"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, numbered, own_names, plain_names

#: Rows of a block, at least.
BLOCK_ROWS = 32
#: Blocks of a whole run, about: the driver's schedule stays so long however many rows there are, as blocks grow.
BLOCKS = 1 << 20


def source_key(name: str) -> Column:
    """A source as a key that tells null from any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    """Rows of each source key; sources are few, like a table of settings."""
    return {r["k"]: r["n"] for r in docs.groupBy(source_key(source_col).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to a power of the sources' sizes: below 1 it lifts small sources."""
    return {k: n**power for k, n in counts.items()}


def capped(counts: dict[str, int], cap: float) -> tuple[dict[str, float], set[str]]:
    """Natural shares, none above ``cap``, and the sources that this lowers; with too few sources for it, none is lowered."""
    lowered: set[str] = set()
    if cap * len(counts) <= 1:
        return {k: float(n) for k, n in counts.items()}, lowered
    while True:
        rest = sum(n for k, n in counts.items() if k not in lowered)
        scale = (1 - cap * len(lowered)) / rest
        over = {k for k, n in counts.items() if k not in lowered and n * scale > cap}
        if not over:
            return {k: cap if k in lowered else n * scale for k, n in counts.items()}, lowered
        lowered |= over


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The same proportions in whole numbers, exactly: a float is a fraction."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("every source needs a finite weight above 0")
    exact = {k: Fraction(w) for k, w in weights.items()}
    common = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    return {k: int(x * common) for k, x in exact.items()}


def pfair_schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """The whole run: ``(source, n, slot, release, deadline, phase)`` for the n-th block of each source, slot by slot.

    A phase lasts until a source has ended; then the others share all slots in proportion to their weights. In a phase of total
    weight W, the n-th block that a source of weight w has in it is released at floor(n W / w) and due at ceil((n + 1) W / w),
    counted from the phase's start, in whole numbers without rounding. Of the blocks released, the one due first takes the slot; as
    the weights fill the slots exactly, all deadlines are met, and after any number of slots a source is less than one
    block from its share, however long the run is.
    """
    whole = whole_weights({k: weights[k] for k, n in blocks.items() if n})
    done, slot, phase = dict.fromkeys(whole, 0), 0, 0
    while done:
        total, start = sum(whole[k] for k in done), slot
        served = dict.fromkeys(done, 0)
        waiting, ready = [(0, k) for k in sorted(done)], []
        while True:
            while waiting and waiting[0][0] <= slot - start:
                release, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(served[k] + 1) * total // whole[k]), k, release))
            due, k, release = heapq.heappop(ready)
            yield k, done[k], slot, start + release, start + due, phase
            slot, served[k] = slot + 1, served[k] + 1
            done[k] += 1
            if done[k] == blocks[k]:
                del done[k]
                phase += 1
                break
            heapq.heappush(waiting, (served[k] * total // whole[k], k))


def mix_sources(
    docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", extra: list[Column] | None = None,
    block_rows: int = BLOCK_ROWS, blocks: int = BLOCKS,
) -> DataFrame:
    """``doc_id, source, block, slot, release, deadline, position, in_mix`` for every row, with ``extra`` columns.

    ``weights`` are by source key (see ``source_key``). Rows of a source are numbered in the order of a hash of the id and
    cut into blocks; blocks take the slots of an earliest-deadline-first Pfair schedule (see ``pfair_schedule``). A block has
    ``block_rows`` rows, or as many more as make about ``blocks`` blocks of all rows: that bounds the schedule, which the driver makes
    and Spark joins. ``position`` numbers all rows in slot order from 0 without gaps; ``in_mix`` is true up to the
    slot where the first source has ended: there the weights hold. No row is dropped or repeated.

    A null source is a source of its own; null and repeated ids are ordinary rows, repeated rows get different positions. An
    empty table gives no rows. A source without a weight is an error, as is a weight that isn't above 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(source_col).alias("_key"), *(extra or []))
    spark = docs.sparkSession
    names = [c for c in rows.columns if c not in ("doc_id", "_key")]
    # Null ids have numbers of their own, so that no block of numbering is hot.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id"))
    rows = checkpointed(rows.withColumn("_spread", spread))
    counts = {r["_key"]: r["n"] for r in rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    if missing := sorted(counts.keys() - weights.keys()):
        raise ValueError(f"no weight for source {missing[0]}")
    size = max(block_rows, -(-sum(counts.values()) // blocks))
    table, ahead = [], 0
    for k, n, slot, release, due, phase in pfair_schedule({k: -(-n // size) for k, n in counts.items()}, weights):
        table.append((k, n, slot, release, due, ahead, phase == 0))
        ahead += min(size, counts[k] - n * size)
    schedule = spark.createDataFrame(table, "_k string, _n long, slot long, release long, deadline long, _ahead long, in_mix boolean")
    place = numbered(rows, ["_key"], ["_spread", "doc_id", *names], "_rank")
    return (
        place.withColumn("block", F.floor(F.col("_rank") / size))
        .join(schedule, (F.col("_key") == F.col("_k")) & (F.col("block") == F.col("_n")))
        .select(
            "doc_id", F.when(F.col("_key") != "null", F.substring("_key", 2, 1 << 30)).alias("source"), *names, "block", "slot", "release", "deadline",
            (F.col("_ahead") + F.col("_rank") % size).alias("position"), "in_mix",
        )
    )


def in_mixture_order(docs: DataFrame, cap: float = 0.2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All documents with their columns, range-partitioned and sorted by their position in a mixture.

    Target weights are the natural shares, lowered to ``cap`` where above; with too few sources for the cap they are the natural
    shares. While all sources last, each is near its weight; later the others follow in proportion, and no row is dropped
    or repeated. Rows alike in id, text and source share the first of their positions.
    """
    counts = source_counts(docs, source_col)
    weights = capped(counts, cap)[0] if counts else {}
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), source_key(source_col))
    plan = mix_sources(docs, weights, id_col, source_col, [key.alias("_of")])
    places = checkpointed(plan.groupBy("_of").agg(F.min("position").alias("_position")))
    own = {c: F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col)}
    source = F.coalesce(F.concat(F.lit("="), F.col(f"c{docs.columns.index(source_col)}").cast("string")), F.lit("null"))
    placed = plain_names(docs).withColumn("_row", F.xxhash64(own[id_col].cast("string"), own[text_col].cast("string"), source)).join(places, F.col("_row") == F.col("_of"))
    return own_names(placed.repartitionByRange("_position").sortWithinPartitions("_position"), docs.columns)
