"""Substring deduplication: windows of words that start in earlier documents, found by sampled grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, id_back, id_of, key_bits, map_batches, split_by_bits
from stopclock.llm.words import SPACES, Step, rolling, words_of

#: Words in the grams that the reference index is keyed by; every window of ``width`` words holds an indexed gram.
GRAM = 10
#: Rows of one index key that are looked up together; a more frequent key is dealt over several salts.
TOGETHER = 4096
_ROWS = 1 << 16


def _indexed(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` words inside one text, by start; where each one's indexed gram starts; all gram hashes.

    Of a window's grams the one with the least hash is indexed, the first of equals, so equal windows choose alike.
    """
    grams = rolling(hashes, GRAM)
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    views = sliding_window_view(grams, width - GRAM + 1)
    least = np.concatenate([views[i : i + _ROWS].argmin(axis=1) for i in range(0, count, _ROWS)]) + np.arange(count)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[:count] == text[width - 1 :])
    return inside, least[inside], grams


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _index_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            for step in words_of(batch.column("text"), SPACES):
                _, at, grams = _indexed(step.hashes(), step.first, width)
                at = np.unique(at)
                row = np.searchsorted(step.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [_signed(grams[at]), pa.array(ids[step.first_row + row]), pa.array(kinds[step.first_row + row]), pa.array((at - step.first[row]).astype(np.int32))],
                    ["gram", "d", "t", "at"],
                )

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = batch.column("d").to_numpy(), batch.column("v").to_numpy()
            places, counts = batch.column("places"), batch.column("counts")
            for step in words_of(batch.column("text"), SPACES):
                hashes = step.hashes()
                start, at, _ = _indexed(hashes, step.first, width)
                frequency = np.zeros(len(hashes), np.int64)
                for i in step.rows:
                    own = places[step.first_row + i].values.to_numpy()
                    frequency[step.first[i] + own] = counts[step.first_row + i].values.to_numpy()
                wanted = frequency[at] > 0
                start, n = start[wanted], frequency[at[wanted]]
                row = np.searchsorted(step.first, start, "right") - 1
                d = ids[step.first_row + row]
                salts = -(-n // TOGETHER)
                variant = variants[step.first_row + row]
                # Texts that share an id, or have none, are dealt out as well.
                salt = ((d ^ variant) * 0x9E3779B1 >> 7) % salts
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(rolling(hashes, width)[start]),
                        pa.array((rolling(hashes, width, seed=0x77)[start] >> np.uint64(33)).astype(np.int32)),
                        pa.array(np.where(salts > 1, salt, -1).astype(np.int32)),
                        pa.array(d),
                        pa.array(variant),
                        pa.array((start - step.first[row]).astype(np.int32)),
                    ],
                    ["w1", "w2", "salt", "d", "v", "at"],
                )

    return run


def repeated_windows(rows: DataFrame, width: int) -> DataFrame:
    """For rows ``d, t, text``: ``d, t, starts``, the starts of windows that also start in a text with a smaller ``d``.

    Only rows with such a window are listed, and rows with equal ``d`` and ``t`` once.
    """
    index = map_batches(rows, _index_rows(width), "gram long, d long, t long, at int")
    stats = index.groupBy("gram").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = checkpointed(stats.where("low < high").select(F.col("gram").alias("g"), "n"))
    places = (
        index.join(shared, F.col("gram") == F.col("g"))
        .groupBy("d", "t")
        .agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("found"))
        .select(F.col("d").alias("pd"), F.col("t").alias("pt"), F.col("found.at").alias("places"), F.col("found.n").alias("counts"))
    )
    places = checkpointed(places)
    some, _ = split_by_bits(rows, ["d", "t"], key_bits(places, ["pd", "pt"]))
    texts = some.dropDuplicates(["d", "t"]).join(places, (F.col("d") == F.col("pd")) & (F.col("t") == F.col("pt")))
    windows = map_batches(texts.select("d", F.col("t").alias("v"), "text", "places", "counts"), _window_rows(width), "w1 long, w2 int, salt int, d long, v long, at int")
    before = Window.partitionBy("w1", "w2", "salt").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Within a salt the first row with the least id is decided by the other salts, if there are any.
    within = checkpointed(windows.withColumn("low", F.min("d").over(before)).where((F.col("low") < F.col("d")) | (F.col("salt") >= 0)))
    sure = within.where("low < d").select("d", "v", "at")
    across = within.where("low = d")
    least = checkpointed(across.groupBy("w1", "w2").agg(F.min("d").alias("least")).select(F.col("w1").alias("l1"), F.col("w2").alias("l2"), "least"))
    more = across.join(least, (F.col("w1") == F.col("l1")) & (F.col("w2") == F.col("l2"))).where("least < d").select("d", "v", "at")
    return sure.union(more).groupBy("d", F.col("v").alias("t")).agg(F.collect_set("at").alias("starts"))


def _covered(step: Step, row: int, starts: np.ndarray | None, width: int) -> np.ndarray:
    """Which words of a row lie in a window with one of the starts."""
    edge = np.zeros(int(step.first[row + 1] - step.first[row]) + 1, np.int64)
    if starts is not None and len(starts):
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:-1] > 0


def _report(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column("text"), batch.column("starts")
            out: tuple[list, list, list, list] = ([], [], [], [])
            for step in words_of(texts, SPACES):
                for i in step.rows:
                    own = starts[step.first_row + i]
                    if own.is_valid:
                        gone = _covered(step, i, own.values.to_numpy(), width)
                        kept = np.flatnonzero(~gone) + step.first[i]
                        words = [step.data[a:b].tobytes() for a, b in zip(step.starts[kept].tolist(), step.ends[kept].tolist(), strict=True)]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    else:
                        gone, edge = step.first[i + 1] - step.first[i], []
                        words = step.data[step.cuts[i] : step.cuts[i + 1]].tobytes().split()
                    out[0].append(int(step.first[i + 1] - step.first[i]))
                    out[1].append(int(step.first[i + 1] - step.first[i]) - len(words))
                    out[2].append(hashlib.sha256(b" ".join(words)).hexdigest())
                    out[3].append(edge)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int32()))],
                ["d", "n_words", "n_removed", "kept_sha256", "factors"],
            )

    return run


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, factors`` for every row.

    Words are runs of bytes other than ASCII white space. A word is removed if it lies in ``width`` consecutive words
    of its text that also start in a text with a smaller id. ``factors`` lists the removed word ranges as start, end …;
    ``kept_sha256`` is the digest of the words kept, joined by one space.

    There is no Lempel-Ziv parse: matching of sampled grams and windows replaces it, as a parse against every block of
    references would read every pair of blocks. Of every window the ten-word gram of least hash is an index key. Windows
    whose gram only one text holds can't repeat and are passed over; all others are decided one by one, by a 96-bit hash of
    their words. ``factors`` are the ranges that the matched windows cover, put together afterwards, so no window depends on them.

    Index keys are counted before the shuffle; windows under a key with more than 4,096 rows are dealt over salts,
    where all but the first are decided, and the first ones meet afterwards. Texts without a shared gram never move.

    Null and empty texts have no words. A null id counts as smaller than all others. Rows that share an id do not
    remove words from each other. Repeated rows get equal results; an empty table gives no rows.
    """
    rows = docs.select(id_of(id_col).alias("d"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    found = checkpointed(repeated_windows(rows, width))
    some, others = split_by_bits(rows, ["d", "t"], key_bits(found, ["d", "t"]))
    found = found.select(F.col("d").alias("fd"), F.col("t").alias("ft"), "starts")
    none = F.lit(None).cast("array<int>").alias("starts")
    schema = "d long, n_words long, n_removed long, kept_sha256 string, factors array<int>"
    hit = some.join(found, (F.col("d") == F.col("fd")) & (F.col("t") == F.col("ft")), "left").select("d", "text", "starts")
    out = map_batches(hit, _report(width), schema).union(map_batches(others.select("d", "text", none), _report(width), schema))
    return out.select(id_back(F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "factors")


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    return repeated_substrings(docs, id_col, text_col, width).drop("factors")
