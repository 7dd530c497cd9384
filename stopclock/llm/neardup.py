"""Near-duplicate groups: bottom-k sketches, inverted lists of their values, exact Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.llm.components import components
from stopclock.llm.shared import Scratch, id_back, id_of, key_bits, map_batches, own_names, plain_names, split_by_bits
from stopclock.llm.words import SPACES, mix, rolling, words_of

#: Values kept of each shingle set: its ``K`` least hashes.
K = 48
#: Members of one group of inverted lists that are compared in one task, as one block with another.
BLOCK = 512
#: Shingles of a block's members, about: a block of long texts has fewer members.
BLOCK_SHINGLES = 400_000
#: Members of one head that are compared with it in one run.
LOT = 256


def _prefix(n: Column, percent: int) -> Column:
    """How many of a sketch's values, rarest first, must be looked up so that no similar pair is missed."""
    mean = K * percent / 100
    far = max(1, math.floor(mean - 6.8 * math.sqrt(mean * (1 - percent / 100))))
    need = F.least(F.lit(far), F.ceil(n * percent / F.lit(100)).cast("int"))
    return F.least(n, F.lit(K)).cast("int") - F.greatest(need, F.lit(1)) + 1


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its sorted distinct shingle hashes; the last word position of a text shorter than a shingle stands for it."""
    for step in words_of(column, SPACES, fold=True):
        hashes = step.hashes()
        grams = rolling(hashes, words)
        for i in step.rows:
            a, b = int(step.first[i]), int(step.first[i + 1])
            if b - a >= words:
                yield step.first_row + i, np.unique(grams[a : b - words + 1])
            elif b > a:
                yield step.first_row + i, mix(rolling(hashes[a:b], b - a, seed=0xB5) + np.uint64(b - a))
            else:
                yield step.first_row + i, np.zeros(0, np.uint64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, kept = [], [], [], []
            for _, values in shingle_sets(batch.column("text"), words):
                size.append(len(values))
                one.append(int(np.bitwise_xor.reduce(mix(values)).view(np.int64)) if len(values) else 0)
                two.append(int(mix(values + np.uint64(0x1F83D9AB)).sum(dtype=np.uint64).view(np.int64)) if len(values) else 0)
                kept.append(values[:K].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("t"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                ["d", "t", "n", "s1", "s2", "sketch"],
            )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` of their union in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(percent: int, words: int):
    """Of rows ``b, a, text``, each lot's head (``a`` null) before its members, the pairs whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            member, keep = batch.column("a").is_valid().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
            for i, values in shingle_sets(batch.column("text"), words):
                if member[i]:
                    keep[i] = similar(values, head, percent)
                else:
                    head = values
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _maybe(sketch: np.ndarray, others: np.ndarray, owner: np.ndarray, sizes: np.ndarray, n: int, ns: np.ndarray, percent: int) -> np.ndarray:
    """Which of several sets may be similar to one, from sizes and the sketch of the union.

    ``others`` holds all sketches end to end with their ``owner``. The least ``K`` values of two sketches together are
    the union's sketch; the share of those in both estimates the similarity.
    """
    fits = (100 * np.minimum(n, ns) >= percent * np.maximum(n, ns))
    at = np.minimum(np.searchsorted(sketch, others), len(sketch) - 1)
    common = sketch[at] == others
    ends = np.cumsum(sizes)
    # Rank of each value in the union: its rank in its own sketch plus the values of the other below it that are not common.
    own_rank = np.arange(len(others)) - np.repeat(ends - sizes, sizes)
    before = np.cumsum(common) - common
    before -= np.repeat(np.concatenate([[0], np.cumsum(common)])[ends - sizes], sizes)
    rank = own_rank + np.searchsorted(sketch, others) - before
    shared = np.bincount(owner[common & (rank < K)], minlength=len(ns))
    union = np.minimum(K, len(sketch) + sizes - np.bincount(owner[common], minlength=len(ns)))
    mean = union * percent / 100
    exact = (n <= K) & (ns <= K) & (union < K)
    slack = np.where(exact, 0, 6.8 * np.sqrt(mean * (1 - percent / 100)))
    return fits & (shared >= np.floor(mean - slack))


def _candidates(percent: int):
    """For one pair of blocks of a group of inverted lists: the members that may be similar to a member of another class."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sketches = [np.asarray(s, np.int64).view(np.uint64) for s in group["sketch"]]
        label, n, side = group["label"].to_numpy(), group["n"].to_numpy(), group["side"].to_numpy()
        sizes = np.array([len(s) for s in sketches])
        others, owner = np.concatenate(sketches), np.repeat(np.arange(len(sketches)), sizes)
        wanted = np.zeros(len(sketches), bool)
        for i, sketch in enumerate(sketches):
            maybe = (label != label[i]) & ((side != side[i]) | (side == 2))
            if maybe.any():
                maybe &= _maybe(sketch, others, owner, sizes, int(n[i]), n, percent)
                if maybe.any():
                    wanted |= maybe
                    wanted[i] = True
        return group.loc[wanted, ["g", "i", "j", "c", "label", "side"]]

    return run


def _links(percent: int, words: int):
    """For the candidates of one pair of blocks: links between classes, compared on whole sets.

    Members already connected, here or before, are not compared again; every other pair is.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [values for _, values in shingle_sets(pa.array(group["text"], pa.string()), words)]
        label = pd.factorize(group["label"])[0]
        ids, side = group["c"].to_numpy(), group["side"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        dense = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        flag = np.zeros(len(dense) + 1, bool)
        found = []
        for i in np.argsort(-sizes):
            rest = np.flatnonzero((label != label[i]) & ((side != side[i]) | (side == 2)))
            if not len(rest):
                continue
            own = dense[starts[i] : starts[i] + sizes[i]]
            flag[own] = True
            both = np.add.reduceat(flag[dense], starts)[rest]
            flag[own] = False
            close = rest[100 * both >= percent * (sizes[i] + sizes[rest] - both)]
            for j in close:
                found.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _in_lots(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``b, lot, a, text``: members of every head in lots of about ``LOT``, each lot with its head's text once (``a`` null)."""
    own = texts.select(F.col("d").alias("_d"), "text")
    sizes = pairs.groupBy(F.col("b").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / LOT).alias("_lots"))
    dealt = pairs.join(sizes, F.col("b") == F.col("_b")).withColumn("lot", F.pmod(F.xxhash64("a"), F.col("_lots"))).select("b", "lot", "a")
    members = dealt.join(own, F.col("a") == F.col("_d")).select("b", "lot", "a", "text")
    heads = dealt.select("b", "lot").distinct().join(own, F.col("b") == F.col("_d")).select("b", "lot", F.lit(None).cast("long").alias("a"), "text")
    return members.union(heads).repartition("b", "lot").sortWithinPartitions("b", "lot", F.asc_nulls_first("a"))


def _texts_of(rows: DataFrame, classes: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``d, text`` of the wanted classes, one row each; texts of others hardly move."""
    some, _ = split_by_bits(rows, ["d"], key_bits(wanted, [column]))
    known = classes.join(wanted.select(F.col(column).alias("_w")).distinct(), F.col("c") == F.col("_w"), "left_semi").select("c", F.col("t").alias("ct"))
    return some.dropDuplicates(["d", "t"]).join(known, (F.col("d") == F.col("c")) & (F.col("t") == F.col("ct")), "left_semi").select("d", "text")


def similar_links(rows: DataFrame, classes: DataFrame, percent: int, words: int, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` between classes, enough to connect all that are connected by similar pairs.

    ``rows`` are ``d, t, text``; ``classes`` has one row ``c, t, n, sketch`` for each distinct non-empty set.
    """
    values = classes.select("c", "t", F.explode("sketch").alias("v"))
    frequency = scratch.keep(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumnRenamed("v", "fv"))
    shared = values.join(frequency, F.col("v") == F.col("fv")).groupBy("c", "t").agg(
        F.array_sort(F.collect_list(F.struct("df", "v"))).alias("values"), F.sum(F.log("df")).alias("weight")
    )
    # Values of one class only come first in order and lead nowhere; they use up the first places of the prefix.
    places = _prefix(F.col("n"), percent) - (F.size("sketch") - F.size("values"))
    lists = (
        classes.join(shared, ["c", "t"])
        .where(places > 0)
        .select("c", "weight", "n", "sketch", F.slice("values", F.lit(1), F.greatest(F.lit(0), F.least(places, F.size("values")))).alias("values"))
    )
    entries = scratch.keep(lists.select("c", "n", "weight", F.explode("values.v").alias("v")))
    stats = entries.groupBy("v").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64(F.col("c"), F.lit(1))).alias("xor"), F.max_by("c", F.struct("weight", "c")).alias("head"),
    )
    # Lists with the same members are one list.
    stats = scratch.keep_small(stats.where("size > 1").groupBy("size", "sum", "xor", "head").agg(F.min("v").alias("lv")).select("lv", "size", "head"))
    members = scratch.keep(entries.join(stats, F.col("v") == F.col("lv")).select("v", "c", "n", "head"))
    scratch.drop(frequency, entries, stats)

    # First every member with the most typical one of its lists: in a group of copies of one text that connects nearly all.
    met = scratch.keep_small(members.where("c != head").select(F.col("c").alias("a"), F.col("head").alias("b")).distinct())
    pairs = scratch.keep(_estimated(met, classes, percent))
    ends = pairs.select(F.col("a").alias("e")).union(pairs.select("b"))
    texts = scratch.keep(_texts_of(rows, classes, ends, "e"))
    first = scratch.keep(map_batches(_in_lots(pairs, texts).select("a", "b", "text"), _verified(percent, words), "a long, b long"))
    scratch.drop(met, pairs, texts)

    # Then the lists whose members are not one component yet, in pairs of blocks.
    labels = components(first, scratch)
    labelled = scratch.keep(
        members.join(labels, F.col("c") == F.col("node"), "left").select("v", "c", "n", "head", F.coalesce("component", "c").alias("label"))
    )
    head_label = labelled.where("c = head").groupBy(F.col("v").alias("hv")).agg(F.min("label").alias("inner"))
    # Lists with heads of one component are one group: they are mostly lists of the same copies of a text.
    placed = labelled.join(head_label, F.col("v") == F.col("hv")).select(F.col("inner").alias("g"), "c", "n", "label", (F.col("label") != F.col("inner")).alias("out"))
    placed = scratch.keep(placed.distinct())
    scratch.drop(members, labels, labelled)
    count = lambda side: F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(side.cast("int")) / BLOCK, F.sum(F.when(side, F.col("n"))) / BLOCK_SHINGLES))).cast("int")
    several = placed.groupBy("g").agg(F.max("out").alias("more"), count(F.col("out")).alias("outer"), count(~F.col("out")).alias("inside")).where("more")
    several = scratch.keep_small(several.select(F.col("g").alias("sg"), "outer", "inside"))
    # Members of the head's component are one another's already: they meet the blocks of the others only.
    hashed = F.xxhash64("c")
    blocked = (
        placed.join(several, F.col("g") == F.col("sg"))
        .withColumn("block", F.when(F.col("out"), F.pmod(hashed, F.col("outer"))).otherwise(F.col("outer") + F.pmod(hashed, F.col("inside"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("outer") + F.col("inside")).otherwise(F.col("outer")) - 1)))
    )
    each = blocked.select(
        "g", "c", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    ).join(classes.select(F.col("c").alias("_c"), "n", "sketch"), F.col("c") == F.col("_c"))
    asked = scratch.keep(each.groupBy("g", "i", "j").applyInPandas(_candidates(percent), "g long, i int, j int, c long, label long, side int"))
    second_texts = _texts_of(rows, classes, asked, "c").select(F.col("d").alias("_d"), "text")
    second = asked.join(second_texts, F.col("c") == F.col("_d")).drop("_d").groupBy("g", "i", "j").applyInPandas(_links(percent, words), "a long, b long")
    links = scratch.keep(first.union(second))
    scratch.drop(first, placed, several, asked)
    return links


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the union's sketch doesn't exclude."""
    own = classes.select(F.col("c").alias("_c"), F.col("n").alias("_n"), F.col("sketch").alias("_s"))
    both = pairs.join(own, F.col("a") == F.col("_c")).select("a", "b", F.col("_n").alias("na"), F.col("_s").alias("sa"))
    both = both.join(own, F.col("b") == F.col("_c")).select("a", "b", "na", "sa", F.col("_n").alias("nb"), F.col("_s").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                sa, sb = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in ("sa", "sb"))
                keep[i] = _maybe(sa, sb, np.zeros(len(sb), np.int64), np.array([len(sb)]), int(na[i]), nb[i : i + 1], percent)[0]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_batches(both, run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; their sets are the distinct runs of ``words`` words, or
    the whole sequence where there are fewer. Texts are linked if their sets have ``percent`` of their union in
    common; ``component_id`` is the least id that links lead to, and the row with that id is kept.

    Rows with equal sets become one class first. Each class keeps a bottom-k sketch, the ``K`` least values of one
    hash function. Inverted lists hold, of every sketch, the rarest values, so many that similar sets share one;
    values that many unlike texts have in common are left out by this without losing a pair. The sketch of the union
    rules pairs out, and whole sets decide. Two rounds spare the pairs inside a group: first every member of a list is compared
    with its most typical one and components are formed; then lists that are not one component yet are
    compared again, those of one head together, in pairs of bounded blocks that give back links, not pairs.

    Null, empty and blank texts have no shingles and are linked with nothing, not even each other; repeated rows
    have one class and each is kept if its id is the least. A null id counts as smaller than all others. Very long texts are
    compared whole, with blocks of fewer members. An empty table gives no rows; other columns are ignored.

    Texts travel once for their own comparison with a head and once for each pair of blocks in which a sketch leaves them a
    possible partner; tables between steps are deleted as soon as they are read for the last time.
    """
    rows = docs.select(id_of(id_col).alias("d"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    made = scratch.keep(map_batches(rows, _sketches(words), "d long, t long, n long, s1 long, s2 long, sketch array<long>"))
    heads = made.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("d", "t")).alias("h"))
    heads = scratch.keep(heads.select(F.col("h.d").alias("c"), F.col("h.t").alias("ht"), F.col("n").alias("hn"), F.col("s1").alias("h1"), F.col("s2").alias("h2")))
    same = (F.col("n") == F.col("hn")) & (F.col("s1") == F.col("h1")) & (F.col("s2") == F.col("h2"))
    classes = made.join(heads, same & (F.col("d") == F.col("c")) & (F.col("t") == F.col("ht")), "inner").dropDuplicates(["c", "ht"]).select("c", "t", "n", "sketch")
    classes = scratch.keep(classes)
    sets = scratch.keep(made.drop("sketch"))
    links = similar_links(rows, classes, percent, words, scratch)
    labels = components(links, scratch)
    named = heads.join(labels, F.col("c") == F.col("node"), "left").select("hn", "h1", "h2", F.coalesce("component", "c").alias("class"))
    named = scratch.keep(named)
    scratch.drop(made, heads, classes, links, labels)
    found = sets.join(named, same, "left").withColumn("component", F.coalesce("class", "d"))
    return found.select(
        id_back(F.col("d")).alias("doc_id"), F.col("n").alias("n_shingles"), id_back(F.col("component")).alias("component_id"), (F.col("d") == F.col("component")).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates of a smaller id, with their columns unchanged, whatever they are called."""
    kept = near_duplicates(docs, percent, words, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    own_id = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    return own_names(plain_names(docs).join(kept, own_id.eqNullSafe(F.col("_kept_id")), "left_semi"), docs.columns)
