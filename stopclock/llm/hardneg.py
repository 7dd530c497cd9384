"""Hard-negative mining: exact integer scores from subset-sum tables of the anchors and bit planes of the candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, id_back, id_of, map_batches

#: Dimensions of one table.
GROUP = 8
#: Candidates of one packed block, at most.
BLOCK = 4096
#: Anchors of one block, about: 256 sums of so many anchors are one table.
ANCHORS = 512
#: Candidates scored together, so that sums stay in the processor's cache.
ROWS = 256


def _bits(values: np.ndarray) -> int:
    """Planes of two's complement that hold all values."""
    if not values.size:
        return 1
    return max(int(values.max()).bit_length(), int(~values.min()).bit_length() if values.min() < 0 else 0) + 1


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Rows × dimensions of whole numbers as bytes, planes × groups × rows; the last plane is the sign's."""
    rows, dims = values.shape
    wide = np.zeros((rows, -(-max(dims, 1) // GROUP) * GROUP), np.int64)
    wide[:, :dims] = values
    planes = [np.packbits(((wide >> b) & 1).astype(np.uint8), axis=1).T for b in range(_bits(values))]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray, groups: int) -> np.ndarray:
    """Groups × 256 × anchors: the sum of an anchor's components of a group that a byte's bits choose."""
    count, dims = anchors.shape
    wide = np.zeros((count, groups * GROUP), np.int64)
    wide[:, : min(dims, groups * GROUP)] = anchors[:, : groups * GROUP]
    most = int(np.abs(wide.astype(object)).sum(axis=1).max()) if count else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    out = np.zeros((groups, 256, count), kind)
    for g in range(groups):
        for j in range(GROUP):
            bit = 1 << j
            out[g, bit : 2 * bit] = out[g, :bit] + wide[:, g * GROUP + GROUP - 1 - j].astype(kind)
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products, rows × anchors: of every plane the looked-up sums of all groups, shifted by the plane's weight."""
    top, groups, rows = len(planes) - 1, len(tables), planes.shape[2]
    bound = int(np.abs(tables.astype(np.float64)).max(initial=0)) * groups << top + 1
    if bound >= 1 << 63:
        raise OverflowError("components are too large for 64-bit scores")
    kind = np.int32 if bound < 1 << 31 else np.int64
    # A plane's sum over all groups never exceeds the sum of an anchor's sizes, for which the tables' type was chosen.
    total = np.zeros((rows, tables.shape[2]), kind)
    plane, part = (np.empty(total.shape, tables.dtype) for _ in range(2))
    for b, bytes_of in enumerate(planes.astype(np.intp)):
        np.take(tables[0], bytes_of[0], axis=0, out=plane, mode="clip")
        for g in range(1, groups):
            np.take(tables[g], bytes_of[g], axis=0, out=part, mode="clip")
            plane += part
        shifted = plane.astype(kind) << b
        total += -shifted if b == top else shifted
    return total


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``d, label, vec`` as blocks of bit planes; ids, labels and planes are raw bytes in native order."""
    part, nth = TaskContext.get().partitionId(), 0
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            order = np.argsort(batch.column("d").to_numpy(), kind="stable")
            values = _matrix(batch.column("vec"))[order]
            planes = bit_planes(values)
            raw = [batch.column(c).to_numpy()[order].tobytes() for c in ("d", "label")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int64()), (nth, pa.int64()), (planes.shape[0], pa.int32()), (planes.shape[1], pa.int32()))]
                + [pa.array([x], pa.binary()) for x in (*raw, planes.tobytes())],
                ["part", "nth", "bits", "groups", "ids", "labels", "planes"],
            )
            nth += 1


_BLOCK_SCHEMA = "part long, nth long, bits int, groups int, ids binary, labels binary, planes binary"


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of whole numbers as a matrix; shorter ones are filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class _Pair:
    """One block of candidates and one of anchors, as read from a joined row."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        scalar = lambda name: batch.column(name)[i]
        self.ids, self.labels = (np.frombuffer(scalar(c).as_py(), np.int64) for c in ("ids", "labels"))
        shape = (scalar("bits").as_py(), scalar("groups").as_py(), len(self.ids))
        self.planes = np.frombuffer(scalar("planes").as_py(), np.uint8).reshape(shape)
        anchors = scalar("anchors").values
        self.anchor = anchors.field("aid").to_numpy()
        self.anchor_label = anchors.field("label").to_numpy()
        self.vectors = _matrix(anchors.field("vec"))
        self.goals = anchors.field("goals") if anchors.type.get_field_index("goals") >= 0 else None


def _first(keys: list[np.ndarray], places: np.ndarray, count: int) -> np.ndarray:
    """Indexes of the first ``count`` entries of every place; ``keys`` order them, the most important last."""
    order = np.lexsort([*keys, places])
    sorted_places = places[order]
    starts = np.flatnonzero(np.diff(sorted_places, prepend=sorted_places[:1] - 1)) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < count]


def _nearest(count: int):
    """The first ``count`` rows of an anchor's own label in each pair of blocks, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = _Pair(batch, i)
                found: list[tuple[np.ndarray, ...]] = []
                for label in np.unique(pair.anchor_label):
                    columns, rows = np.flatnonzero(pair.anchor_label == label), np.flatnonzero(pair.labels == label)
                    tables = subset_sums(pair.vectors[columns], pair.planes.shape[1])
                    for a in range(0, len(rows), ROWS):
                        own = rows[a : a + ROWS]
                        score = scores(tables, pair.planes[:, :, own]).T
                        # Candidates are in order of their ids, which a stable sort keeps for ties.
                        best = np.argsort(-score, axis=1, kind="stable")[:, :count]
                        found.append((np.repeat(columns, best.shape[1]), np.take_along_axis(score, best, 1).ravel().astype(np.int64), pair.ids[own[best.ravel()]]))
                if found:
                    column, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
                    chosen = _first([ids, -score], column, count)
                    yield pa.RecordBatch.from_arrays([pa.array(pair.anchor[column[chosen]]), pa.array(score[chosen]), pa.array(ids[chosen])], ["aid", "score", "other"])

    return run


def _between(count: int, low: int, high: int):
    """For every anchor and goal (a positive's score) the first ``count`` rows of other labels inside the goal's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = _Pair(batch, i)
                goal = _matrix(pair.goals)
                present = np.arange(goal.shape[1]) < np.diff(pair.goals.offsets.to_numpy())[:, None]
                least, most = -((-low * goal) // 100), (high * goal) // 100
                floor = np.where(present, least, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
                ceiling = np.where(present, most, np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
                tables = subset_sums(pair.vectors, pair.planes.shape[1])
                kept: list[tuple[np.ndarray, ...]] = []
                for a in range(0, len(pair.ids), ROWS):
                    score = scores(tables, pair.planes[:, :, a : a + ROWS])
                    hit = (score >= floor) & (score <= ceiling) & (pair.labels[a : a + ROWS, None] != pair.anchor_label)
                    row, column = np.nonzero(hit)
                    value = score[row, column].astype(np.int64)
                    inside = present[column] & (value[:, None] >= least[column]) & (value[:, None] <= most[column])
                    nth, goal_of = np.nonzero(inside)
                    row, column, value = a + row[nth], column[nth], value[nth]
                    chosen = _first([pair.ids[row], -value], column * goal.shape[1] + goal_of, count)
                    kept.append((column[chosen], goal_of[chosen], value[chosen], pair.ids[row[chosen]]))
                if kept:
                    column, goal_of, value, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
                    chosen = _first([ids, -value], column * goal.shape[1] + goal_of, count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair.anchor[column[chosen]]), pa.array(goal_of[chosen].astype(np.int32)), pa.array(value[chosen]), pa.array(ids[chosen])],
                        ["aid", "nth", "score", "other"],
                    )

    return run


def _meeting(blocks: DataFrame, anchors: DataFrame, block_count: int, anchor_blocks: int) -> DataFrame:
    """Every block of candidates with every block of anchors, each pair one row, dealt over as many partitions."""
    lots = max(1, block_count)
    parts = min(max(1, lots * anchor_blocks), 20_000)
    each = blocks.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))).withColumn("lot", F.pmod(F.xxhash64("part", "nth"), F.lit(lots)).cast("int"))
    lent = anchors.select(F.col("ab").alias("_ab"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("_lot"), "anchors")
    return each.repartition(parts, "ab", "lot").join(lent.repartition(parts, "_ab", "_lot"), (F.col("ab") == F.col("_ab")) & (F.col("lot") == F.col("_lot"))).select(
        "bits", "groups", "ids", "labels", "planes", "anchors"
    )


def _best(found: DataFrame, places: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of every place, numbered; Spark keeps so many per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*places).orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= count)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor and positive.

    Components become ``floor(scale * x)``; a score is the inner product of two such vectors, exact in whole numbers. An
    anchor's positives are its ``positives`` best other rows of its label, and for each the first ``negatives`` rows of other labels
    with ``low`` to ``high`` percent of the positive's score come back; higher scores come first, ties by the smaller id.
    ``is_anchor`` is a condition on ``rows``.

    Scores come from tables: for every eight dimensions the 256 sums of subsets of an anchor's components. A candidate is kept as bit
    planes, one byte per plane and eight dimensions, which looks its sum up; sums of planes are shifted and added. Candidates
    are packed in blocks where they are read, anchors come in blocks of about 512, and each pair of blocks is scored by one
    task, twice: the positives' scores must be known before negatives can be chosen. Only the best of a pair of blocks move.

    Rows take no part if their label or vector is null or a component is null or not finite. Shorter vectors are filled
    up with zeros, so an empty one scores 0. A null id counts as smaller than all others. Repeated rows are rows of their
    own: a copy of an anchor may be its positive, and repeated anchors give repeated results. Components so large that a score
    could exceed 64 bits are an error. Without anchors or rows there are no results. Other columns are ignored.
    """
    good = F.col(vector_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(
        F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(scale)).cast("long"))
    taken = rows.where(good).select(id_of(id_col).alias("d"), F.col(label_col).cast("long").alias("label"), whole.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    anchors = checkpointed(taken.where("_anchor").groupBy("d", "label", "vec").agg(F.count(F.lit(1)).alias("times")))
    anchor_blocks = max(1, -(-anchors.count() // ANCHORS))
    inside = Window.partitionBy("ab").orderBy("d", "label", "vec")
    numbered = anchors.withColumn("ab", F.pmod(F.xxhash64("d", "label", "vec"), F.lit(anchor_blocks)).cast("int")).withColumn(
        "aid", F.col("ab").cast("long") * F.lit(1 << 31) + F.row_number().over(inside)
    )
    numbered = checkpointed(numbered)
    blocks = checkpointed(map_batches(taken.select("d", "label", "vec"), _packed, _BLOCK_SCHEMA))
    block_count = blocks.count()
    # An anchor finds itself among its own label's rows, so one more is looked for.
    blocked = numbered.groupBy("ab").agg(F.collect_list(F.struct("aid", "label", "vec")).alias("anchors"))
    near = map_batches(_meeting(blocks, blocked, block_count, anchor_blocks), _nearest(positives + 1), "aid long, score long, other long")
    near = _best(near, ["aid"], positives + 1).groupBy("aid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "other"))).alias("near"))
    own = F.struct((-F.expr("aggregate(vec, 0L, (s, x) -> s + x * x)")).alias("minus"), F.col("d").alias("other"))
    with_near = numbered.join(near.withColumnRenamed("aid", "_aid"), F.col("aid") == F.col("_aid")).withColumn("self", F.array_position("near", own).cast("int"))
    # One entry like the anchor itself goes; if it isn't among them, the last goes.
    others = F.expr(f"filter(near, (x, i) -> i != if(self > 0, self - 1, {positives}))")
    chosen = checkpointed(with_near.withColumn("near", others).select("ab", "aid", "d", "label", "vec", "times", "near"))
    goals = F.expr("transform(near, x -> -x.minus)").alias("goals")
    asked = chosen.where(F.size("near") > 0).groupBy("ab").agg(F.collect_list(F.struct("aid", "label", "vec", goals)).alias("anchors"))
    found = map_batches(_meeting(blocks, asked, block_count, anchor_blocks), _between(negatives, low, high), "aid long, nth int, score long, other long")
    found = _best(found, ["aid", "nth"], negatives).select(F.col("aid").alias("_aid"), "nth", "rank", "score", "other")
    return (
        chosen.select("aid", F.col("d").alias("anchor"), "times", "near")
        .join(found, F.col("aid") == F.col("_aid"))
        .withColumn("_goal", F.expr("near[nth]"))
        .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .select(
            id_back(F.col("anchor")).alias("anchor_id"), id_back(F.col("_goal.other")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            id_back(F.col("other")).alias("negative_id"), (-F.col("_goal.minus")).alias("positive_score"), F.col("score").alias("negative_score"),
        )
    )

