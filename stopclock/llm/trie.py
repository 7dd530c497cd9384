"""Prefix trie of conversations: padded matrices of turn ids, sorted and folded depth by depth, in ranges of the sorted order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, map_batches

#: Turns (plus conversations) of one range, about.
RANGE_TURNS = 250_000
#: Turns that one padded matrix holds of every conversation; longer ones go on in the next matrix.
COLUMNS = 8
#: Ranges whose boundary nodes are put together by one task.
FAN = 256
EMPTY = hashlib.sha256(b"").hexdigest()

_LISTS = ["n", "least", "done", "kids", "leaves", "saved"]
_SCHEMA = (
    "kind int, level int, shard long, side int, key binary, conv_id long, depth long, parent_conv_id long, parent_side int, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ids binary, seq binary, words array<long>, first long, " + ", ".join(f"{c} array<long>" for c in _LISTS)
)
_TYPES = {
    "kind": pa.int32(), "level": pa.int32(), "shard": pa.int64(), "side": pa.int32(), "key": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(),
    "parent_conv_id": pa.int64(), "parent_side": pa.int32(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(), "ids": pa.binary(), "seq": pa.binary(), "words": pa.list_(pa.int64()), "first": pa.int64(), **{c: pa.list_(pa.int64()) for c in _LISTS},
}
#: Kinds of rows: a finished node; a node at the edge of a range; the ids that end at such a node; a boundary path.
NODE, OPEN, ENDS, PATH = range(4)


def turn_sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c, ids, words`` of every conversation: its turns' ids (an MD5 of role and text) and word counts in order of turn.

    Null turns come first, turns of one number in the order of their ids; a null role or text is empty. Rows without a
    conversation id belong to none. Texts don't move: a turn is 40 bytes when conversations are gathered.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"),
        F.struct(
            F.col(turn_col).isNotNull().alias("set"), F.col(turn_col).cast("long").alias("turn"),
            F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
        ).alias("t"),
    )
    listed = rows.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("c", F.col("t.id").alias("ids"), F.col("t.w").alias("words"))


def branched(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin like a base: the first h turns of conversation ``c - c % every``, then c's own after its first h.

    h is the unsigned CRC-32 of the decimal id modulo ``most``. A base that doesn't exist gives no turns.
    """
    plain = checkpointed(sequences)
    base = plain.where(F.col("c") % every == 0).select(F.col("c").alias("_b"), *[F.slice(x, 1, most).alias(f"_{x}") for x in ("ids", "words")])
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int")
    joined = plain.join(base, F.col("c") - F.col("c") % every == F.col("_b"), "left")

    def both(own: str, kind: str) -> Column:
        ahead = F.slice(F.coalesce(F.col(f"_{own}"), F.array().cast(kind)), F.lit(1), h)
        return F.concat(ahead, F.slice(own, h + 1, F.greatest(F.size(own) - h, F.lit(0)))).alias(own)

    return joined.select("c", both("ids", "array<string>"), both("words", "array<bigint>"))


def sorted_prefixes(turns: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of sequences of turn ids (two numbers a turn), ties by ``ids``, and what each shares with the one before it.

    Padded matrices of ``COLUMNS`` turns are sorted one after the other; only sequences that go on, and inside
    classes that are equal so far, take part in the next. Where two neighbours differ, the mask of changed columns is
    OR-accumulated, and its unset columns are their common turns. The first one has -1 in common.
    """
    lens = np.diff(offsets)
    order, common = np.arange(len(lens)), np.full(len(lens), -1, np.int64)
    places, group, start = np.arange(len(lens)), np.zeros(len(lens), np.int64), 0
    while len(places):
        rows = order[places]
        inside = start + np.arange(COLUMNS) < lens[rows, None]
        matrix = np.zeros((len(rows), COLUMNS, 2), np.uint64)
        matrix[inside] = turns[(offsets[rows, None] + start + np.arange(COLUMNS))[inside]]
        matrix = matrix.reshape(len(rows), -1)
        size = np.minimum(lens[rows], start + COLUMNS + 1)
        by = np.lexsort([ids[rows], size, *matrix.T[::-1], group])
        rows, matrix = rows[by], matrix[by]
        order[places] = rows
        changed = (matrix[1:] != matrix[:-1]).reshape(-1, COLUMNS, 2).any(axis=2)
        equal = COLUMNS - np.logical_or.accumulate(changed, axis=1).sum(axis=1)
        same = group[1:] == group[:-1]
        shared = np.minimum(start + equal, np.minimum(lens[rows[1:]], lens[rows[:-1]]))
        common[places[1:][same]] = shared[same]
        classes = np.cumsum(np.append(True, ~same | (equal < COLUMNS)))[: len(rows)]
        more = lens[rows] > start + COLUMNS
        places, group, start = places[more], classes[more], start + COLUMNS
    return order, common


class _Conversations:
    """What conversations in sorted order add to the nodes on their way."""

    def __init__(self, lens: np.ndarray, ids: np.ndarray):
        self.lens, self.ids = lens, ids

    def at(self, depth: int, rows: np.ndarray) -> dict[str, np.ndarray]:
        none = np.zeros(len(rows), np.int64)
        return {"n": none + 1, "least": self.ids[rows], "done": (self.lens[rows] == depth).astype(np.int64), "kids": none, "leaves": none, "saved": none}


class _Paths:
    """What boundary paths add: sums over the ranges they come from, from depth ``first`` on."""

    def __init__(self, first: np.ndarray, lists: dict[str, list[np.ndarray]]):
        self.first = first
        self.starts = np.cumsum([0, *map(len, lists["n"])])[:-1]
        self.flat = {c: np.concatenate(x).astype(np.int64) for c, x in lists.items()}

    def at(self, depth: int, rows: np.ndarray) -> dict[str, np.ndarray]:
        there = depth >= self.first[rows]
        at = np.where(there, self.starts[rows] + depth - self.first[rows], 0)
        return {c: np.where(there, x[at], np.iinfo(np.int64).max if c == "least" else 0) for c, x in self.flat.items()}


def fold(lens: np.ndarray, common: np.ndarray, words: np.ndarray, offsets: np.ndarray, parts: _Conversations | _Paths, edges: bool) -> Iterator[dict[str, np.ndarray]]:
    """All nodes of sorted sequences, depth by depth from the deepest, each depth as columns.

    A node is a run of neighbours that share its turns. With ``edges`` the first and last run of a depth stay open, as
    they may go on in another range: their ``side`` is 0 or 1, and their sums hold what closed nodes below them add.
    ``parent_side`` tells that a closed node's parent is open.
    """
    longest_first = np.argsort(-lens, kind="stable")
    ordered = -lens[longest_first]
    saved, leaves, child = (np.zeros(len(lens), np.int64) for _ in range(3))
    below: dict[str, np.ndarray] | None = None
    marked = np.zeros(0, np.int64)
    for depth in range(int(lens.max()), -1, -1):
        rows = np.sort(longest_first[: np.searchsorted(ordered, -depth, "right")])
        starts = np.flatnonzero(np.append(True, common[rows[1:]] < depth))
        head = rows[starts]
        last = rows[np.append(starts[1:], len(rows)) - 1]
        part = parts.at(depth, rows)
        sums = {c: np.add.reduceat(part[c], starts) for c in ("n", "done", "kids", "leaves", "saved")}
        sums["least"] = np.minimum.reduceat(part["least"], starts)
        for name, below_it in (("kids", child), ("leaves", leaves), ("saved", saved)):
            sums[name] += np.add.reduceat(below_it[rows], starts)
        side = np.where(head == 0, 0, np.where(last == len(lens) - 1, 1, -1)) if edges else np.full(len(head), -1)
        if below is not None:
            run = np.searchsorted(head, below["head"], "right") - 1
            yield below | {"parent_side": side[run], "parent": sums["least"][run]}
        closed = side < 0
        own = (sums["n"] - 1) * (words[offsets[head] + depth - 1] if depth else 0)
        leaf = sums["done"] == sums["n"]
        child[marked], marked = 0, head[closed]
        child[marked] = 1
        saved[marked] += own[closed]
        leaves[marked] += leaf[closed]
        sums["saved"] = np.where(closed, sums["saved"] + own, sums["saved"])
        sums["leaves"] = np.where(closed, sums["leaves"] + leaf, sums["leaves"])
        below = {"depth": np.full(len(head), depth), "head": head, "side": side, **sums}
    yield below | {"parent_side": np.full(len(below["head"]), -1), "parent": np.full(len(below["head"]), -1)}


def _prefix_keys(sequence: bytes) -> list[bytes]:
    """A key for every prefix of a sequence of turn ids, the empty one first."""
    digest, keys = hashlib.md5(), []
    for k in range(0, len(sequence) + 1, 16):
        keys.append(digest.copy().digest())
        digest.update(sequence[k : k + 16])
    return keys


def _table(rows: list[dict], **columns) -> pa.RecordBatch:
    """Rows, or columns, with nulls in all columns not given."""
    given = columns or {c: [r.get(c) for r in rows] for c in {k for r in rows for k in r}}
    size = len(rows) if rows else len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(size, t) for c, t in _TYPES.items()], list(_TYPES))


def _folded(level: int, shard: int, sequences: list[bytes], words: np.ndarray, offsets: np.ndarray, lens: np.ndarray, common: np.ndarray, parts, edges: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one range: its finished nodes, and its edges. ``sequences`` are those of the first and last row."""
    ids = getattr(parts, "ids", None)
    keys = [_prefix_keys(s) for s in sequences]
    paths: list[dict[str, list[int]]] = [{c: [] for c in ("depth", *_LISTS)} for _ in keys]
    others: list[dict] = []
    for nodes in fold(lens, common, words, offsets, parts, edges):
        depth = int(nodes["depth"][0])
        ends = np.full(len(nodes["head"]), EMPTY, object)
        if ids is not None:
            for i in np.flatnonzero(nodes["done"]):
                # Those that end at a node are the first of its run, by id.
                text = ",".join(map(str, ids[nodes["head"][i] : nodes["head"][i] + nodes["done"][i]].tolist())).encode()
                if nodes["side"][i] < 0:
                    ends[i] = hashlib.sha256(text).hexdigest()
                else:
                    others.append({"kind": ENDS, "level": level, "shard": shard, "key": keys[nodes["side"][i]][depth], "ids": text})
        closed = np.flatnonzero(nodes["side"] < 0)
        if len(closed):
            some = {c: nodes[c][closed] for c in ("least", "depth", "n", "kids", "leaves", "saved")}
            inner = nodes["parent_side"][closed] >= 0
            orphan = inner | (some["depth"] == 0)
            columns = {
                "kind": np.full(len(closed), NODE), "level": np.full(len(closed), level), "shard": np.full(len(closed), shard), "conv_id": some["least"], "depth": some["depth"],
                "parent_conv_id": pa.array(nodes["parent"][closed], pa.int64(), mask=orphan), "parent_side": pa.array(nodes["parent_side"][closed], pa.int32(), mask=~inner),
                "n_convs": some["n"], "n_children": some["kids"], "n_leaves": some["leaves"], "saved_tokens": some["saved"],
            }
            if level == 0:
                columns["ends_sha256"] = ends[closed]
            else:
                columns["key"] = [parts.key(int(nodes["head"][i]), depth) for i in closed]
            yield _table([], **columns)
        for i in np.flatnonzero(nodes["side"] >= 0):
            side = int(nodes["side"][i])
            others.append({"kind": OPEN, "level": level, "shard": shard, "side": side, "depth": depth, "key": keys[side][depth]})
            for c in _LISTS:
                paths[side][c].append(int(nodes[c][i]))
            paths[side]["depth"].append(depth)
    for side, path in enumerate(paths):
        if path["depth"]:
            at = 0 if side == 0 else len(lens) - 1
            others.append(
                {"kind": PATH, "level": level, "shard": shard, "side": side, "seq": sequences[side], "words": words[offsets[at] : offsets[at] + lens[at]].tolist(), "first": path["depth"][-1]}
                | {c: path[c][::-1] for c in _LISTS}
            )
    if others:
        yield _table(others)


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All conversations ``c, key, words`` of a range."""
    whole = list(batches)
    if not sum(b.num_rows for b in whole):
        return
    table = pa.Table.from_batches(whole)
    ids = table.column("c").to_numpy()
    raw = table.column("key").combine_chunks()
    lists = table.column("words").combine_chunks()
    raw, lists = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (raw, lists))
    sequences = b"".join(x.as_py() for x in raw)
    offsets = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()))).astype(np.int64)
    words = lists.flatten().to_numpy().astype(np.int64)
    turns = np.frombuffer(sequences, ">u8").astype(np.uint64).reshape(-1, 2)
    order, common = sorted_prefixes(turns, offsets, ids)
    ends = [sequences[16 * offsets[i] : 16 * offsets[i + 1]] for i in (order[0], order[-1])]
    lens = np.diff(offsets)[order]
    yield from _folded(0, TaskContext.get().partitionId(), ends, words, offsets[:-1][order], lens, common, _Conversations(lens, ids[order]), True)


class _Boundary(_Paths):
    def __init__(self, group: pd.DataFrame):
        super().__init__(group["first"].to_numpy(), {c: [np.asarray(x) for x in group[c]] for c in _LISTS})
        self._keys = [_prefix_keys(s) for s in group["seq"]]

    def key(self, row: int, depth: int) -> bytes:
        return self._keys[row][depth]


def _combined(level: int, edges: bool):
    """The boundary paths of up to ``FAN`` ranges as one range."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["shard", "side"], ignore_index=True)
        turns = [np.frombuffer(s, np.uint8).reshape(-1, 16) for s in group["seq"]]
        lens = np.array([len(t) for t in turns])
        common = np.full(len(turns), -1, np.int64)
        for i in range(1, len(turns)):
            size = min(lens[i - 1], lens[i])
            differ = (turns[i - 1][:size] != turns[i][:size]).any(axis=1)
            common[i] = int(differ.argmax()) if differ.any() else size
        words = np.concatenate([np.asarray(x, np.int64) for x in group["words"]])
        offsets = np.cumsum(lens) - lens
        made = _folded(level, int(key[0]), [group["seq"].iloc[0], group["seq"].iloc[-1]], words, offsets, lens, common, _Boundary(group), edges)
        return pa.Table.from_batches(list(made)).to_pandas(integer_object_nulls=True)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of rows with one key, over their ids in order; what a node's ids are in one piece is never held."""
    last, digest = None, hashlib.sha256()
    for batch in batches:
        keys, hashes = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
            if key != last:
                if last is not None:
                    keys.append(last)
                    hashes.append(digest.hexdigest())
                last, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "sha"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["key", "sha"])


def prefix_trie(sequences: DataFrame, range_turns: int = RANGE_TURNS, fan: int = FAN) -> DataFrame:
    """One row per node of the prefix trie of conversations ``c, ids, words`` (see ``turn_sequences``).

    A node is a distinct sequence of first turns, the root the empty one. Columns: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes below, itself included), ``saved_tokens`` (over all nodes
    below and itself: members but one, times words of the last text), ``ends_sha256`` (of the comma-joined ids that end here).

    Conversations are range-partitioned by their turn ids and then their own id, so thousands of equal ones may lie in several ranges.
    A task sorts its range's padded matrix of turn ids with ``lexsort``; the OR-accumulated mask of changed columns marks where nodes
    start, and ``reduceat`` sums every depth. Only the nodes on the paths of a range's first and last conversation can go on in
    other ranges: they come back as partial sums, of which ``fan`` ranges at a time are folded again in the same way, in rounds. The hash of
    a node that spans ranges is taken over its ranges' ids in order, streamed.

    Conversations of any length are allowed, but a conversation's turn ids (not its texts) are one row. Repeated rows are repeated
    turns. Without conversations there are no rows, not even a root.
    """
    rows = checkpointed(sequences.select("c", F.unhex(F.array_join("ids", "")).alias("key"), "words"))
    total = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    spread = min(rows.sparkSession.sparkContext.defaultParallelism, total // 5_000)
    ranges = max(1, -(-total // range_turns), spread)
    spread_out = rows.repartitionByRange(ranges, "key", "c")
    level, made = 0, [checkpointed(map_batches(spread_out, _range, _SCHEMA))]
    # Spark may deal to another number of ranges than was asked for.
    ranges = (made[0].agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        level, ranges = level + 1, -(-ranges // fan)
        paths = made[-1].where(F.col("kind") == PATH).withColumn("_g", F.floor(F.col("shard") / fan))
        made.append(checkpointed(paths.groupBy("_g").applyInPandas(_combined(level, ranges > 1), _SCHEMA)))
        if ranges <= 1:
            break
    every = made[0]
    for more in made[1:]:
        every = every.union(more)
    nodes = every.where(F.col("kind") == NODE)
    joined_ends = made[0].where(F.col("kind") == ENDS).select("key", "shard", "ids").repartition("key").sortWithinPartitions("key", "shard")
    hashes = map_batches(joined_ends, _hashed, "key binary, sha string").select(F.col("key").alias("_key"), "sha")
    edge = nodes.where("key is not null").join(hashes, F.col("key") == F.col("_key"), "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))
    edge = checkpointed(edge.select(*nodes.columns))
    # An open parent is looked up by its place in the range where its child was finished.
    named = edge.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
    opened = every.where(F.col("kind") == OPEN).join(named, F.col("key") == F.col("_key")).select(
        F.col("level").alias("_level"), F.col("shard").alias("_shard"), F.col("side").alias("_side"), F.col("depth").alias("_depth"), "_conv"
    )
    at = (F.col("level") == F.col("_level")) & (F.col("shard") == F.col("_shard")) & (F.col("parent_side") == F.col("_side")) & (F.col("depth") == F.col("_depth") + 1)
    found = nodes.where("key is null").union(edge).join(checkpointed(opened), at, "left")
    return found.select("conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
