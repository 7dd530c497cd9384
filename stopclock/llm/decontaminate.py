"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.llm.shared import map_batches, open_folder, output_folder, removed_at_exit
from stopclock.llm.words import MARKS, Step, texts_of, words_of
from stopclock.session import hadoop_path

#: Bytes of item text in one automaton, about; larger benchmarks get several. A block takes about 300 bytes of memory a byte
#: while it is built, in one task, and about 10 where documents are read.
BLOCK_BYTES = 2 << 20
#: Bytes of text that pass one automaton after the other together.
TOGETHER = 16 << 20


class Building:
    """Suffix automaton of many word sequences, with the items of every window, as it is built.

    States hold the longest length, the suffix link and the transitions of the textbook construction. A *window* is
    ``width`` consecutive words of an item, or a whole shorter item.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int):
        self.width = width
        self.names = [name for name, _ in items]
        words = [w for _, w in items]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [np.searchsorted(self.vocabulary, w).tolist() for w in words]
        for sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.shortest = min([width, *(len(s) for s in coded if s)])
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        #: For a match of ``width`` words or more, the state of its last ``width`` words.
        self.window = [-1] * len(self.length)
        for state in order[1:]:
            link = self.link[state]
            if self.length[state] >= width:
                self.window[state] = state if self.length[link] < width else self.window[link]
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, sequence in enumerate(coded):
            for state, matched, at in self._walk(sequence):
                if matched >= width:
                    self.full.setdefault(self.window[state], set()).add(item)
                elif len(sequence) < width and at == len(sequence) - 1:
                    self.short.setdefault(state, []).append((matched, item))
        #: The nearest state from here along the links where a short item ends.
        self.ends = [-1] * len(self.length)
        for state in order[1:]:
            self.ends[state] = state if state in self.short else self.ends[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._new(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _new(self, length: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _walk(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """For each word: the state of the longest suffix read so far that some item contains, and its length."""
        state = matched = 0
        for at, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            yield state, matched, at

    def flat(self) -> dict[str, bytes | int | str]:
        """The automaton as arrays, end to end; see ``Automaton``."""
        following = [sorted(n.items()) for n in self.next]
        states = range(len(self.length))
        full = [sorted(self.full.get(s, ())) for s in states]
        short = [self.short.get(s, []) for s in states]

        def starts(lists: list) -> list[int]:
            return [0, *np.cumsum([len(x) for x in lists]).tolist()]

        arrays = {
            "length": self.length, "link": self.link, "window": self.window, "ends": self.ends,
            "first": starts(following), "word": [w for n in following for w, _ in n], "target": [t for n in following for _, t in n],
            "full_first": starts(full), "full_item": [i for x in full for i in x],
            "short_first": starts(short), "short_length": [n for x in short for n, _ in x], "short_item": [i for x in short for _, i in x],
        }
        return {
            "shortest": self.shortest, "names": json.dumps(self.names), "vocabulary": self.vocabulary.tobytes(),
            **{c: np.array(x, np.int32).tobytes() for c, x in arrays.items()},
        }


ARRAYS = ["length", "link", "window", "ends", "first", "word", "target", "full_first", "full_item", "short_first", "short_length", "short_item"]
_FLAT = "block int, shortest int, names string, vocabulary binary, " + ", ".join(f"{c} binary" for c in ARRAYS)


class Automaton:
    """A built automaton in flat arrays of four bytes: 16 bytes a state and 8 a transition, in place of objects.

    The transitions of a state lie together, sorted by word, from ``first[state]`` on; so do the items of its windows.
    """

    def __init__(self, width: int, row: dict):
        self.width, self.shortest, self.names = width, row["shortest"], json.loads(row["names"])
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        for c in ARRAYS:
            setattr(self, c, memoryview(row[c]).cast("i"))

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def _follow(self, state: int, word: int) -> int:
        """The state after a word, or -1."""
        a, b = self.first[state], self.first[state + 1]
        if b - a > 1:
            a = bisect.bisect_left(self.word, word, a, b)
        return self.target[a] if a < b and self.word[a] == word else -1

    def hits(self, sequence: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans ``[a, b)`` of all windows in a sequence of known words, and their items."""
        spans, items = [], set()
        state = matched = 0
        for at, word in enumerate(sequence):
            after = self._follow(state, word)
            while state and after < 0:
                state = self.link[state]
                matched = self.length[state]
                after = self._follow(state, word)
            if after >= 0:
                state, matched = after, matched + 1
            if matched >= self.width:
                spans.append((at + 1 - self.width, at + 1))
                window = self.window[state]
                items.update(self.full_item[self.full_first[window] : self.full_first[window + 1]])
            end = self.ends[state]
            while end > 0:
                for k in range(self.short_first[end], self.short_first[end + 1]):
                    length = self.short_length[k]
                    if length <= matched:
                        spans.append((at + 1 - length, at + 1))
                        items.add(self.short_item[k])
                end = self.ends[self.link[end]]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for step in words_of(pa.array(texts, pa.string()), MARKS, fold=True):
        h = step.hashes()
        out += [h[step.first[i] : step.first[i + 1]] for i in step.rows]
    return out


def automata(benchmark: DataFrame, folder: str, id_col: str, text_col: str, width: int, block_bytes: int = BLOCK_BYTES) -> list[int]:
    """Writes one automaton per block of items under ``folder``, each built by a task of its own, and returns the blocks."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.where(F.col("text") != "").distinct()
    # An item longer than a block counts as one block.
    total = items.agg(F.sum(F.least(F.octet_length("text"), F.lit(block_bytes)))).first()[0] or 0
    blocks = -(-total // block_bytes)
    if not blocks:
        return []

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"])
        known = [(name, h) for name, h in zip(rows["id"], _hashes(rows["text"].tolist()), strict=True) if len(h)]
        flat = [{"block": key[0], **Building(known, width).flat()}] if known else []
        return pd.DataFrame(flat, columns=["block", "shortest", "names", "vocabulary", *ARRAYS])

    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    built = dealt.groupBy("block").applyInPandas(build, _FLAT)
    built.write.partitionBy("block").parquet(folder)
    spark = benchmark.sparkSession
    path, fs = hadoop_path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(int(n.removeprefix("block=")) for n in names if n.startswith("block="))


_loaded: dict[tuple[str, int], Automaton] = {}


def _automaton(folder: str, block: int, width: int) -> Automaton:
    """One block's automaton, read from the shared folder; a worker holds one at a time."""
    found = _loaded.get((folder, block))
    if found is None:
        _loaded.clear()
        fs, root = open_folder(folder)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/block={block}")) if f.base_name.startswith("part-")]
        row = pq.ParquetFile(fs.open_input_file(files[0])).read().to_pylist()[0]
        found = _loaded[folder, block] = Automaton(width, row)
    return found


def _find(automaton: Automaton, texts: pa.Array, spans: list[list[int]], items: list[list[str]]) -> None:
    """Adds what an automaton finds in texts to their spans and items."""
    for step in words_of(texts, MARKS, fold=True):
        first = step.first
        if not len(step.starts):
            continue
        codes = automaton.code(step.hashes())
        known = np.concatenate([[False], codes >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x < automaton.shortest:
                continue
            while x < y:  # a run may reach over the ends of texts
                row = bisect.bisect_right(first, x) - 1
                stop = min(y, int(first[row + 1]))
                found, which = automaton.hits(codes[x:stop].tolist())
                if found:
                    at, shift = step.first_row + row, x - int(first[row])
                    both = [*zip(*[iter(spans[at])] * 2, strict=True), *((p + shift, q + shift) for p, q in found)]
                    spans[at] = [v for pair in merged(both) for v in pair]
                    items[at] = sorted({*items[at], *(automaton.names[i] for i in which)})
                x = stop


def _scan(folder: str, blocks: list[int], width: int, most: float | None = None):
    """A map over batches with a column ``_text``, adding ``_n, _spans, _items`` after all automata, one at a time.

    With ``most``, spans are cut out of the texts of which they cover no larger share.
    """

    def finished(batch: pa.RecordBatch, spans: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("_text"))
        n = np.zeros(batch.num_rows, np.int64)
        new = texts.to_pylist() if most is not None and any(spans) else None
        data, offsets = texts_of(texts)
        for step in words_of(texts, MARKS, fold=True):
            n[step.first_row : step.first_row + len(step.rows)] = np.diff(step.first)
            if new is not None:
                for i in step.rows:
                    own = spans[step.first_row + i]
                    if own and sum(own[1::2]) - sum(own[::2]) <= most * n[step.first_row + i]:
                        new[step.first_row + i] = _cut(data[offsets[step.first_row] :], step, i, own)
        columns = [pa.array(new, texts.type) if new is not None and name == "_text" else batch.column(i) for i, name in enumerate(batch.schema.names)]
        added = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *added], names=[*batch.schema.names, "_n", "_spans", "_items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = [([[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]) for b in group]
            for block in blocks:
                automaton = _automaton(folder, block, width)
                for batch, (spans, items) in zip(group, found, strict=True):
                    _find(automaton, batch.column(batch.schema.get_field_index("_text")), spans, items)
            for batch, (spans, items) in zip(group, found, strict=True):
                yield finished(batch, spans, items)
            group.clear()

        for batch in batches:
            group.append(batch)
            if len(blocks) < 2 or sum(b.nbytes for b in group) >= TOGETHER:
                yield from flush()
        yield from flush()

    return run


def _scanned(
    docs: DataFrame, benchmark: DataFrame, keep: list[Column], width: int, text_col: str,
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, most: float | None = None,
) -> DataFrame:
    """The columns ``keep`` with ``_text, _n, _spans, _items`` after a pass through every automaton, and the cut."""
    folder = removed_at_exit(docs.sparkSession, output_folder(docs.sparkSession, "automata"))
    blocks = automata(benchmark, f"{folder}/built", item_id, item_text, width, block_bytes)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = rows.select("*", F.lit(0).cast("long").alias("_n"), F.array().cast("array<int>").alias("_spans"), F.array().cast("array<string>").alias("_items")).schema
    return map_batches(rows, _scan(f"{folder}/built", blocks, width, most), schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[Column], width: int = 10, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` of every document with ``n_words``, ``spans`` and ``items``.

    Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A window is ``width``
    consecutive words of an item; an item with fewer words, but not none, is one window. ``spans`` holds the word
    ranges covered by windows as start, end, start, end …; ``items`` the ids, as sorted strings, of items with a
    window in the document.

    Documents stream through the automaton of the items: per word one step, the longest match so far is kept, and a
    match of ``width`` words or more, or of a whole short item, is a hit. Rows never move. An automaton covers about
    ``block_bytes`` of items and lies in flat arrays in the shared folder, where a task of its own has put it. Larger benchmarks make several:
    a task takes some megabytes of text through one after the other, and holds one at a time, so memory doesn't grow with the benchmark.

    Null and empty texts have no words and no hits; items without words match nothing, null item ids are named
    ``null``, and items that share an id count once. Repeated rows are treated alike; an empty benchmark hits nothing.
    """
    rows = _scanned(docs, benchmark, keep, width, text_col, item_id, item_text, block_bytes)
    return rows.select(*rows.columns[: len(keep)], F.col("_n").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def span_words(spans: Column) -> Column:
    """Number of words in spans given as start, end, start, end …"""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row; see ``contamination``."""
    found = contamination(docs, benchmark, [F.col(id_col).cast("long").alias("doc_id")], width)
    n_hit = span_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_spans(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, max_share: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The documents with benchmark spans cut out; a document covered by more than ``max_share`` goes as a whole.

    Words of a span are removed with what stands between them; the rest of the text stays as it was. ``n_chars``, where
    present, follows the new text. Documents without a hit, and those without words, are returned unchanged.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    found = _scanned(docs, benchmark, [F.col(f"`{c}`").alias(own) for c, own in place.items()], width, text_col, most=max_share)
    share = span_words(F.col("_spans")) / F.greatest(F.col("_n"), F.lit(1))
    cleaned = found.where(share <= max_share).select(F.col("_text").alias("text"), F.col("_spans").alias("spans"), *place.values())
    columns = {c: F.col(own) for c, own in place.items()} | {text_col: F.col("text").cast(docs.schema[text_col].dataType)}
    if "n_chars" in place:
        chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("spans") > 0, chars).otherwise(columns["n_chars"])
    return cleaned.select(*[columns[c].alias(c) for c in docs.columns])


def _cut(data: np.ndarray, step: Step, row: int, spans: list[int]) -> str:
    """A row's text without the words of its spans; ``data`` are the step's bytes as they were before lower-casing."""
    base, at, out = int(step.first[row]), int(step.cuts[row]), []
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : step.starts[base + a]].tobytes())
        at = int(step.ends[base + b - 1])
    out.append(data[at : step.cuts[row + 1]].tobytes())
    return b"".join(out).decode()
