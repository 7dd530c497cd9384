"""Each operator against a brute-force version on odd rows, and on an empty table."""

from __future__ import annotations

import collections
import ctypes
import hashlib
import heapq
import itertools
import math
import re
import zlib
from fractions import Fraction
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from conftest import TESTDATA
from llm import messy
from stopclock.llm import decontaminate, exact, language, licences, lines, mixing, neardup, shards, substrings, tokens
from stopclock.llm.components import components
from stopclock.llm.shared import Scratch, map_batches, numbered, output_folder
from stopclock.llm.words import SPACES, words_of

SF = str(TESTDATA / "sf0.001")
MEDIUM = str(TESTDATA / "sf0.01")


@pytest.fixture(scope="module")
def docs(spark):
    return messy.frame(spark).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(found, expected):
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))


def check_near(docs, pairs, percent, words):
    component = messy.near_components(pairs, percent, words)
    expected = []
    for i, text in pairs:
        c = component[messy.ident(i)]
        expected.append((i, messy.shingle_count(text, words), None if c == messy.NO_ID else c, c == messy.ident(i)))
    same(neardup.near_duplicates(docs, percent, words), expected)


def test_near_duplicates_link_all_that_brute_force_links(docs, pairs):
    check_near(docs, pairs, 85, 3)


def test_near_duplicates_with_pipeline_settings(docs, pairs):
    check_near(docs, pairs, 80, 5)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A list with several components, cut into many small blocks, loses no link."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(60):  # chains: each copy differs from its neighbours only a little
        words = [f"{w}{'' if j >= 3 * (i % 15) else 'c' + str(i // 15)}" for j, w in enumerate(base)]
        rows.append((int(rng.permutation(1000)[i]) + 1000 * i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 60):
        component = messy.near_components(rows, percent, 3)
        found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table, percent, 3).collect()}
        assert found == component


def test_union_sketch_never_excludes_a_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        b = a.copy()
        change = rng.random(len(a)) < rng.random() * 0.2
        b[change] = rng.integers(0, 1 << 63, int(change.sum()), dtype=np.int64).astype(np.uint64)
        b = np.unique(b)
        if neardup.similar(a, b, 85):
            sa, sb = a[: neardup.K], b[: neardup.K]
            assert neardup._maybe(sa, sb, np.zeros(len(sb), int), np.array([len(sb)]), len(a), np.array([len(b)]), 85)[0]


def test_one_of_each_keeps_columns(docs):
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert 11 in ids and not ids & {12, 13, 14}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_mixing_follows_a_plain_simulation(docs, pairs):
    weights = {"=hot": 5.0, "=s0": 2.0, "=s3": 1.0, "null": 1.0, "=s1": 0.1, "=s2": 0.5, "=s4": 1 / 3}
    found = mixing.mix_sources(docs, weights, block_rows=2).collect()
    assert sorted(r["position"] for r in found) == list(range(len(pairs)))
    order = sorted(found, key=lambda r: r["position"])
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in found)
    used = collections.defaultdict(set)
    for r in found:
        used[r["slot"]].add((r["source"], r["block"], r["release"], r["deadline"], r["in_mix"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len(u) == 1 for u in used.values()) and sorted(used) == list(range(len(used)))
    counts = collections.Counter("null" if r["source"] is None else "=" + r["source"] for r in found)
    assert counts == collections.Counter("null" if r["source"] is None else "=" + r["source"] for r in docs.select("source").collect())
    # Blocks slot by slot against fluid shares, in whole fractions.
    left = {k: -(-n // 2) for k, n in counts.items()}
    done, fluid = dict.fromkeys(left, 0), dict.fromkeys(left, Fraction(0))
    for slot in range(len(used)):
        total = sum(Fraction(weights[k]) for k in left)
        for k in left:
            fluid[k] += Fraction(weights[k]) / total
        source = next(iter(used[slot]))[0]
        source = "null" if source is None else "=" + source
        done[source] += 1
        assert all(abs(done[k] - fluid[k]) < 1 for k in left)
        left[source] -= 1
        if not left[source]:
            del left[source]
            fluid = {k: Fraction(done[k]) for k in left}


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 1, "b": 1e-9}, {"a": 1.0, "b": 1 / 3, "c": math.pi / 10, "d": 0.0001}, {str(i): i**0.5 + 1.0 for i in range(50)}])
def test_mixture_stays_within_a_block_of_the_targets(weights):
    total = sum(Fraction(w) for w in weights.values())
    done, slots = collections.Counter(), 100 * 4096 if len(weights) < 9 else 20_000
    endless = dict.fromkeys(weights, 10**9)
    for source, n, slot, release, due, phase in itertools.islice(mixing.pfair_schedule(endless, weights), slots):
        assert n == done[source] and release <= slot < due and phase == 0
        done[source] += 1
        if slot % 97 == 0 or slot > slots - 50:
            assert all(abs(done[k] - (slot + 1) * Fraction(w) / total) < 1 for k, w in weights.items())


def test_blocks_grow_so_that_the_schedule_stays_short(spark):
    table = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    found = mixing.mix_sources(table, mixing.tempered(mixing.source_counts(table)), blocks=50).collect()
    assert sorted(r["position"] for r in found) == list(range(5000)) and 50 <= max(r["slot"] for r in found) + 1 <= 56


def test_mixing_without_a_weight_fails(docs):
    with pytest.raises(Exception, match="no weight"):
        mixing.mix_sources(docs, {"=hot": 1.0}).collect()


def test_shards_hold_groups_together_and_are_even(docs, pairs):
    found = shards.shard_documents(docs, shards=3).collect()
    assert len(found) == len(pairs)
    text = dict(pairs)
    of_text = collections.defaultdict(set)
    for r in found:
        value = text[r["doc_id"]]
        data = (value or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        of_text[value].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    for k in range(3):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("largest, count, shards_", [(1000, 200, 8), (3, 5000, 7), (10**9, 40, 3), (5, 6, 1), (2, 3, 9)])
def test_sizes_are_placed_as_by_a_plain_heap(largest, count, shards_):
    rng = np.random.default_rng(largest)
    sizes = rng.integers(1, largest, count, endpoint=True).tolist()
    heap, expected = [(0, k) for k in range(shards_)], collections.Counter()
    for size in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        expected[size, k] += 1
        heapq.heappush(heap, (load + size, k))
    runs = sorted(collections.Counter(sizes).items(), reverse=True)
    found = {(size, k): n for size, taken in shards.longest_first(runs, shards_) for k, n in enumerate(taken) if n}
    assert found == expected


def test_documents_go_where_a_plain_heap_puts_their_sizes(docs, pairs):
    sizes = collections.Counter()
    for _, text in pairs:
        sizes[text] += len((text or "").encode()) + 1
    heap, expected = [(0, k) for k in range(3)], collections.Counter()
    for size in sorted(sizes.values(), reverse=True):
        load, k = heapq.heappop(heap)
        expected[k, size] += 1
        heapq.heappush(heap, (load + size, k))
    text, found = dict(pairs), set()
    for r in shards.shard_documents(docs, shards=3).collect():
        found.add((r["shard"], text[r["doc_id"]]))
    assert collections.Counter((k, sizes[t]) for k, t in found) == expected


def test_shards_of_a_larger_table_differ_little(spark):
    table = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    sizes = [r["n"] for r in shards.shard_documents(table).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.001 * sum(sizes)


def test_written_shards_hold_all_rows(spark, docs):
    for table in (docs, docs.withColumnRenamed("label", "Shard").withColumnRenamed("d", "_group").withColumnRenamed("t", "_size")):
        path = output_folder(spark, "shards")
        name = shards.write_shards(table, path, shards=3)
        assert name == ("shard" if table is docs else "_shard")
        back = spark.read.parquet(path)
        assert sorted(map(repr, back.select(*table.columns).collect())) == sorted(map(repr, table.collect()))


def test_exact_dedup(docs, pairs):
    groups = collections.defaultdict(list)
    for i, text in pairs:
        groups[text or ""].append(i)
    expected = []
    for i, text in pairs:
        keep = max((x for x in groups[text or ""] if x is not None), default=None)
        expected.append((i, keep, len(groups[text or ""]), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    same(exact.exact_dedup(docs), expected)
    kept = exact.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r["text"] or "" for r in kept.collect()} == set(groups)


ITEMS = [(0, None), (1, "?!"), (2, "two words"), (3, "words"), (None, "été ÜBER".lower()), (4, "x" * 1_500_000), (4, "same same same"), (5, "one")]


def test_contamination(spark, docs, pairs):
    passage = messy.texts()[30].split()
    items = [*ITEMS, (6, " ".join(passage[25:60])), (7, " ".join(passage[25:40])), (8, " ".join(["same"] * 12))]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = messy.contaminated(pairs, items, 10)
    same(decontaminate.contamination_report(docs, table), expected)
    # Several automata give the same as one.
    found = decontaminate.contamination(docs, table, [F.col("doc_id")], block_bytes=400)
    assert sorted((str(r["doc_id"]), r["n_words"], len(r["items"])) for r in found.collect()) == sorted((str(e[0]), e[1], e[3]) for e in expected)
    clean = decontaminate.without_spans(docs, table)
    assert clean.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    for (i, text), e in zip(pairs, expected, strict=True):
        assert (i in left) == (e[2] <= 0.5 * e[1]), i
        if i in left and not e[5]:
            assert left[i] == text
    assert decontaminate.contamination_report(docs, table.limit(0)).where("contaminated").count() == 0


def test_spans_are_cut_out_of_texts_with_capitals(spark):
    passage = " ".join(f"word{k}" for k in range(12))
    rows = [(1, f"I am A BIG B. {passage.upper()}! And THE END, Ünder MARKS."), (2, f"NO {passage} x" * 3), (3, "NOT here, I say.")]
    items = spark.createDataFrame([("q", passage)], "item_id string, text string")
    found = decontaminate.without_spans(spark.createDataFrame([(i, t + " and so ON it goes for A while longer than that" * 2) for i, t in rows], "doc_id long, text string"), items)
    left = {r["doc_id"]: r["text"] for r in found.collect()}
    rest = " and so ON it goes for A while longer than that" * 2
    assert left == {1: "I am A BIG B. ! And THE END, Ünder MARKS." + rest, 2: "NO  xNO  xNO  x" + rest, 3: rows[2][1] + rest} or set(left) == {1, 3}
    assert left[1] == "I am A BIG B. ! And THE END, Ünder MARKS." + rest and left[3] == rows[2][1] + rest


def test_large_benchmarks_are_held_in_part(spark):
    """Blocks of some hundred kilobytes from 3 MB of items: the same hits as one automaton, each a small part of memory."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    items = [(f"i{k}", " ".join(rng.choice(words, 400))) for k in range(1500)]
    docs = [(k, " ".join([*rng.choice(words, 30), *items[k * 7][1].split()[50 : 50 + 9 + k % 5], *rng.choice(words, 30)])) for k in range(200)]
    table, benchmark = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id string, text string")
    found = {r["doc_id"]: r["items"] for r in decontaminate.contamination(table, benchmark, [F.col("doc_id")], block_bytes=400_000).collect()}
    assert all((f"i{k * 7}" in found[k]) == (k % 5 > 0) for k in range(200))
    folder = output_folder(spark, "automata")
    blocks = decontaminate.automata(benchmark, folder, "item_id", "text", 10, 400_000)
    assert len(blocks) >= 6
    sizes = [sum(getattr(a, c).nbytes for c in decontaminate.ARRAYS) for a in (decontaminate._automaton(folder, b, 10) for b in blocks)]
    assert max(sizes) < 12 * 600_000 and len(decontaminate._loaded) == 1


def test_boilerplate_lines(docs, pairs):
    for sites in (2, 3):
        spread = collections.defaultdict(set)
        records = docs.select("doc_id", "text", "source").collect()
        for r in records:
            for line in (r["text"] or "").split("\n"):
                spread[line.strip(" \t\r")].add(r["source"])
        expected = []
        for r in records:
            every = (r["text"] or "").split("\n")
            kept = [x for x in every if not x.strip(" \t\r") or len(spread[x.strip(" \t\r")]) < sites]
            expected.append((r["doc_id"], len(every) if r["text"] else 0, len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        same(lines.line_report(docs, sites), expected)


def test_boilerplate_near_the_threshold_is_counted(spark):
    rows = [(f"k{n}", f"site{s}") for n in range(60, 141) for s in range(n) for _ in range(2)]
    found = lines.boilerplate(spark.createDataFrame(rows, "key string, site string"), 100)
    assert {r["key"] for r in found.collect()} == {f"k{n}" for n in range(100, 141)}


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "nothing"), (3, "a/b/y.py", "more text"),
        (4, "a/b/COPYING.txt", "x\nThis work is licensed under the GNU General Public License, version 3."), (5, "c/z.py", None),
        (6, "top.py", ""), (7, None, "none"), (8, "a/b/c/w.py", "Licensed under CC BY-NC 4.0."), (9, "ab/v.py", "text"), (2, "a/x.py", "nothing"),
    ]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, file string, text string, path string").repartition(2)
    found = {r["doc_id"]: (r["licence"], r["how"]) for r in licences.scan_licences(table, F.col("file")).collect()}
    assert found == {
        1: ("MIT", "header"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "inherited"), 4: ("GPL-3.0", "header"), 5: (None, "none"),
        6: (None, "none"), 7: (None, "none"), 8: ("CC-BY-NC-4.0", "header"), 9: (None, "none"),
    }
    assert licences.scan_licences(table, F.col("file")).count() == len(rows)


@pytest.mark.parametrize("together", [substrings.TOGETHER, 2])
def test_repeated_substrings(docs, pairs, together, monkeypatch):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    same(substrings.substring_report(docs), messy.kept_words(pairs, 50))


def test_substrings_of_other_widths(docs, pairs):
    same(substrings.substring_report(docs, width=20), messy.kept_words(pairs, 20))


def test_language_of_odd_rows(docs, pairs):
    found = language.identify(docs).collect()
    assert len(found) == len(pairs)
    for r in found:
        text = dict(pairs)[r["doc_id"]]
        letter = text is not None and any(map(str.isalpha, text))
        assert (r["lang_pred"] in ("en", "de")) == letter and (r["lang_pred"] == "und") == (not letter)
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
    assert language.known_language(docs).columns == docs.columns


def test_language_on_held_out_documents(spark):
    table = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


def test_forward_sums_all_segmentations():
    pieces = language.load_pieces()
    rng = np.random.default_rng(2)
    chances = rng.random((len(pieces), 2)) / len(pieces)
    number = {p: i for i, p in enumerate(pieces.pieces)}

    def total(word: bytes, k: int) -> float:
        if not word:
            return 1.0
        return sum(chances[number[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in number)

    data = np.frombuffer("the nation über".encode(), np.uint8)
    starts, ends = np.array([0, 4, 11]), np.array([3, 10, 16])
    found = language.log_likelihoods(pieces, chances, data, starts, ends)
    for i in range(3):
        word = b" " + data[starts[i] : ends[i]].tobytes()
        assert np.allclose(found[i], [np.log(total(word, k)) for k in range(2)])


@pytest.mark.parametrize("limit", [language.LONG, 4])
def test_long_words_are_summed_whole(monkeypatch, limit):
    monkeypatch.setattr(language, "LONG", limit)
    pieces = language.load_pieces()
    rng = np.random.default_rng(3)
    chances = rng.random((len(pieces), 2)) / len(pieces)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    words = [b"donaudampfschifffahrtsgesellschaftskapitaen" * 3, "\u0434\u043e\u0441\u0442\u043e\u043f\u0440\u0438\u043c\u0435\u0447\u0430\u0442\u0435\u043b\u044c\u043d\u043e\u0441\u0442\u044c".encode(), b"x" * 200, b"a"]
    data = np.frombuffer(b" " + b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) for w in words]
    found = language.log_likelihoods(pieces, chances, data, starts, ends)
    for word, logs in zip(words, found, strict=True):
        whole = b" " + word
        for k in range(2):
            sums = [Fraction(1)]
            for end in range(1, len(whole) + 1):
                sums.append(sum((sums[a] * Fraction(chances[number[whole[a:end]], k]) for a in range(max(0, end - pieces.longest), end) if whole[a:end] in number), Fraction(0)))
            exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert abs(exact - logs[k]) < 1e-9 * abs(exact)


def test_text_of_no_learned_language_goes(spark):
    table = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rng = np.random.default_rng(1)
    strange = [
        "".join(chr(c) for c in rng.choice(list(range(0x430, 0x450)) + [32] * 6, 600)), " ".join("".join(chr(c) for c in rng.integers(97, 123, 9)) for _ in range(60)),
        " ".join(["zzxqj qqkzw xjjqv wvvxz"] * 20),
    ]
    more = spark.createDataFrame([(10**6 + i, t, None, "odd", len(t)) for i, t in enumerate(strange)], table.schema)
    left = {r["doc_id"] for r in language.known_language(table.union(more)).select("doc_id").collect()}
    assert not {10**6 + i for i in range(len(strange))} & left
    assert {r["doc_id"] for r in table.collect() if r["text"] and any(map(str.isalpha, r["text"]))} <= left


def test_training_order_round_trip(spark, docs, pairs):
    path = output_folder(spark, "tokens")
    tokens.write_training_order(docs, path, key=9, length=64, per_shard=512)
    index = tokens.read_index(spark, path).toPandas()
    records = tokens.read_records(spark, path).toPandas().set_index("slot")["record"]
    assert sorted(index["slot"]) == list(range(len(index))) == sorted(records.index)
    encoding = tiktoken.Encoding("v", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})
    expected = collections.Counter((i, text or "") for i, text in pairs)
    found = collections.Counter()
    for i, own in index.groupby("doc_id", dropna=False):
        i = None if np.isnan(i) else int(i)
        copies = int((own["seq"] == 0).sum())
        # Repeated rows have equal records.
        own = own.drop_duplicates("seq").sort_values("seq")
        ids = np.concatenate([np.frombuffer(records[r.slot], "<u2")[: r.n_tokens] for r in own.itertuples()])
        assert ids[-1] == tokens.END
        found[(i, encoding.decode(ids[:-1].tolist()))] += copies
    assert found == expected
    start = len(index) // 2
    assert sorted(tokens.read_records(spark, path, start).toPandas()["slot"]) == list(range(start, len(index)))


def test_records_of_all_shards_are_not_collected_in_the_driver(spark):
    """Records are as many as the corpus has sequences, though the manifest they are read by is small."""
    docs = spark.range(50).selectExpr("id as doc_id", "repeat(concat('word ', id, ' '), 1 + id % 7) as text")
    out = tokens.training_order(docs, output_folder(spark, "tokens"), key=2, length=4, per_shard=20)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "[slot#" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert sorted(r["slot"] for r in out.collect()) == list(range(out.count())) and out.count() > 100


def test_records_are_read_in_pieces_of_a_shard(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('word ', id, ' '), 1 + id % 40) as text")
    path = output_folder(spark, "tokens")
    tokens.write_training_order(docs, path, key=2, length=16, per_shard=400)
    shards = {r["shard"]: (r["base"], r["rows"], r["stride"]) for r in tokens.read_manifest(spark, path).collect()}
    assert len(shards) > 2 and min(n * stride for _, n, stride in shards.values()) > 2000
    expected = []
    for shard, (base, n, stride) in shards.items():
        data = Path(path, "shards", f"shard-{shard:012d}.bin").read_bytes()
        expected += [(base + k, shard, k, data[k * stride : (k + 1) * stride]) for k in range(n)]
    start = sorted(base for base, _, _ in shards.values())[1] + 7
    # No value may hold a whole shard.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        for piece in (tokens._PIECE, 1000, 1):
            monkeypatch.setattr(tokens, "_PIECE", piece)
            assert sorted((r["slot"], r["shard"], r["row"], bytes(r["record"])) for r in tokens.read_records(spark, path).collect()) == sorted(expected)
        assert sorted(r["slot"] for r in tokens.read_records(spark, path, start).collect()) == list(range(start, len(expected)))
        assert tokens.read_records(spark, path, len(expected)).collect() == []
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_places_of_files_need_no_python_worker(spark):
    path = output_folder(spark, "files")
    spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text").repartitionByRange(3, "doc_id").write.parquet(path)
    placed = tokens.placed_documents(spark.read.parquet(path), Scratch(spark, "places"))
    # A table made of Python rows is an RDD that Python workers serialise.
    assert "ExistingRDD" not in placed._jdf.queryExecution().toString()
    assert [r["pos"] for r in placed.orderBy("pos").collect()] == list(range(100))


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not glibc")
def test_workers_give_back_what_a_task_has_freed():
    def taken():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    class Table:
        sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda _: str(1 << 20)))

        def mapInArrow(self, function, _):
            return function

    last = []

    def busy(batches):
        rows = [bytes(1000) for _ in range(200_000)]
        last.append(rows[-1])  # above all others, so that these don't go by themselves
        yield from batches

    before = taken()
    assert list(map_batches(Table(), busy, "x long")(iter([1]))) == [1]
    assert last and taken() - before < 100


def test_training_order_depends_on_key_and_data_alone(spark, docs):
    path = output_folder(spark, "whole-table")
    docs.where("doc_id is null or doc_id < 40").write.parquet(path)
    found = []
    for size, parts, key in (("60k", None, 4), ("128m", None, 4), ("128m", 7, 4), ("128m", None, 5)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        table = spark.read.parquet(path)
        out = tokens.training_order(table.repartition(parts, F.rand(1)) if parts else table, output_folder(spark, "tokens"), key=key, length=32, per_shard=100)
        found.append(sorted(map(tuple, out.collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2] and found[0] != found[3]


def test_windows_keep_the_order_of_the_files_in_the_large(spark):
    path = output_folder(spark, "files")
    spark.range(1000).selectExpr("999 - id as doc_id", "repeat(concat('word ', id, ' '), id % 7) as text").repartitionByRange(4, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(path)
    out = tokens.training_order(spark.read.parquet(path), output_folder(spark, "tokens"), key=3, length=8, per_shard=128, window=50).collect()
    order = [(999 - r["doc_id"]) // 50 for r in sorted(out, key=lambda r: r["slot"])]
    assert order == sorted(order) and set(order) == set(range(20))
    inside = [(r["doc_id"], r["seq"]) for r in sorted(out, key=lambda r: r["slot"])][:100]
    assert inside != sorted(inside, reverse=True)


def test_feistel_is_a_keyed_permutation():
    for size in (1, 2, 3, 17, 1000, 4097):
        a, b = (tokens.Feistel(size, key)(np.arange(size)) for key in (1, 2))
        assert sorted(a) == sorted(b) == list(range(size))
        assert size < 17 or (a != b).any()


def test_word_bounds_and_hashes_in_pieces(pairs):
    import pyarrow as pa

    texts = [t for _, t in pairs]
    found = []
    for step in words_of(pa.array(texts, pa.string()), SPACES):
        hashes = step.hashes()
        found += [hashes[step.first[i] : step.first[i + 1]].tolist() for i in step.rows]
    words = [messy.spaced(t) for t in texts]
    assert [len(f) for f in found] == [len(w) for w in words]
    by_word = {}
    for f, w in zip(found, words, strict=True):
        for h, x in zip(f, w, strict=True):
            assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_numbers_have_no_gaps(spark):
    table = spark.range(5000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "id % 700 as x")
    found = numbered(table, ["k"], ["x"], "number", blocks=16).collect()
    for k in (None, 0, 1):
        own = sorted(r["number"] for r in found if r["k"] == k)
        assert own == list(range(len(own))) and own


CLASHES = "_id _digest _kept_id _row _of _position _key _rank _spread _group _size _at _ranges shard c0 c1 c2 d t b".split()


@pytest.mark.parametrize("keep", [exact.kept_documents, neardup.one_of_each, mixing.in_mixture_order, language.known_language, lambda d: decontaminate.without_spans(d, d.selectExpr("doc_id as item_id", "text").limit(0))])
def test_documents_keep_columns_with_the_names_of_internal_ones(spark, keep):
    rows = [(i, f"a few words of text {i} and then some" if i % 3 else "the same words each time", "s", *(f"{c}{i}" for c in CLASHES)) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)).withColumn("lang", F.lit("en"))
    found = keep(table)
    assert found.columns == table.columns
    whole = {r["doc_id"]: r for r in table.collect()}
    kept = found.collect()
    assert len(kept) >= 10 and all(r == whole[r["doc_id"]] for r in kept)


@pytest.mark.parametrize(
    "run",
    [
        neardup.near_duplicates, neardup.one_of_each, lambda d: mixing.mix_sources(d, mixing.tempered(mixing.source_counts(d))), mixing.in_mixture_order, shards.shard_documents,
        exact.exact_dedup, exact.kept_documents, lambda d: decontaminate.contamination_report(d, d.selectExpr("doc_id as item_id", "text")),
        lambda d: decontaminate.without_spans(d, d.selectExpr("doc_id as item_id", "text")), lines.line_report,
        lambda d: licences.scan_licences(d, F.col("source")), substrings.substring_report, language.identify, language.known_language,
        lambda d: tokens.training_order(d, output_folder(d.sparkSession, "none")),
    ],
)
def test_empty_tables(spark, run):
    assert run(messy.empty(spark)).collect() == []


def test_every_labelled_text_teaches_the_pipeline(spark):
    """Of more labelled texts than a sample of a thousand: the odd one that such a sample leaves out is learned from, and stays."""
    plain = " ".join(f"the quick brown fox and lazy dog number of words {w}" for w in ("one", "two", "three", "four"))
    odd = " ".join(["zzxqj qqkzw xjjqv wvvxz"] * 20)
    ids = spark.range(10**6, 10**6 + 60).select(F.col("id").alias("doc_id"), F.lit(odd).alias("text"))
    out = ids.where(~language.is_held_out("doc_id") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(1 << 30) > 0.6)).first()["doc_id"]
    table = spark.createDataFrame([(i, plain, "en") for i in range(3000)] + [(out, odd, "en"), (-1, None, "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language.known_language(table).select("doc_id").collect()} == {*range(3000), out}
