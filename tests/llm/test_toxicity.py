"""Toxicity: the decoder against enumeration, disguised words, held-out accuracy and odd input."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest import TESTDATA, rows
from stopclock.llm import toxicity
from tests.llm import messy

WORDS = "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()


@pytest.fixture(scope="module")
def model():
    text = " ".join(WORDS * 3 + "the lost are in that town and some hit parts of it is a rest on sand you him this".split() * 5)
    return toxicity.CharacterModel(toxicity.symbol_triples(pa.array([text])).astype(float))


def best_path(token: str, model) -> float:
    """The chance of the likeliest reading, over all of them."""
    best = -np.inf
    for path in itertools.product(*toxicity.lattice(token)):
        x = y = toxicity.EDGE
        total = 0.0
        for text, p in path:
            total += p
            for c in text:
                z = toxicity._symbol(c) if c.isalpha() else toxicity.EDGE
                total, x, y = total + model.log[x][y][z], y, z
        best = max(best, total + model.log[x][y][toxicity.EDGE])
    return best


def reading_chance(token: str, reading: str, model) -> float:
    return max(
        (sum(p for _, p in path) for path in itertools.product(*toxicity.lattice(token)) if "".join(t for t, _ in path) == reading), default=-np.inf
    ) + sum(
        model.log[a][b][c] for s in [[0, 0, *(toxicity._symbol(c) if c.isalpha() else 0 for c in reading), 0]] for a, b, c in zip(s, s[1:], s[2:], strict=False)
    )


@pytest.mark.parametrize("token", ["m0r0n", "1d10t", "l o s e r", "s-t-u-p-i-d", "trrraash", "5cum", "a1b2c3", "$$!!", "1 1 1", "w0rthle55", "éé1x"])
def test_decoder_finds_the_likeliest_reading(model, token):
    found = toxicity.restored(token, model)
    assert reading_chance(token, found, model) == pytest.approx(best_path(token, model))


@pytest.mark.parametrize("word", WORDS)
def test_disguises_are_undone(model, word):
    restore = toxicity.Restorer(model)
    leet = word.translate(str.maketrans("oieast", "013457"))
    for hidden in (leet, " ".join(word), ".".join(word), " ".join(leet), word[:2] + word[2] * 5 + word[3:], word.upper().translate(str.maketrans("A", "@"))):
        assert word in restore(f"You are {hidden} again").split(), hidden


def test_plain_text_stays_as_it_is(model):
    plain = "the sand, and some parts; of it - is the rest.\n\téé ñandú 12 345 (and) $5 a+ ok!"
    assert toxicity.Restorer(model)(plain) == plain


def test_triples_of_pieces_add_up():
    rng = random.Random(1)
    text = "".join(rng.choice("abcé .1") for _ in range(700_000)) * 2
    found = toxicity.symbol_triples(pa.array(["", None, text]))
    classes = [27 if ord(c) > 127 else ord(c) - 96 if c.isalpha() else 0 for c in text]
    a = np.array(classes)
    expected = np.bincount((a[:-2] * 28 + a[1:-1]) * 28 + a[2:], minlength=28**3)
    # A piece may begin inside a letter of two bytes.
    assert abs(found - expected).sum() <= 6


def labelled(spark, n: int = 600, disguise: bool = False):
    rng = random.Random(7)
    plain = [("".join(rng.choice("aeioutrnls") for _ in range(rng.randint(2, 8)))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 40))]
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(WORDS, 2):
                words.insert(rng.randrange(len(words)), w.replace("o", "0").replace("i", "1") if disguise and i % 8 else w)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark, disguise=True)
    found = {r["doc_id"]: r for r in toxicity.detect_toxicity(docs, labels).collect()}
    held = [i for i, r in found.items() if r["held_out"]]
    assert 150 < len(held) < 250
    assert sum(found[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    docs, labels = labelled(spark)
    held = [r["doc_id"] for r in toxicity.score_toxicity(docs, toxicity.Model(toxicity.CharacterModel(np.zeros(28**3)), {}, 0.1)).where("held_out").collect()]
    turned = labels.withColumn("toxic", (labels.toxic != labels.doc_id.isin(held).cast("int")).cast("int"))
    assert rows(toxicity.detect_toxicity(docs, labels)) == rows(toxicity.detect_toxicity(docs, turned))


def test_odd_input(spark):
    docs = messy.frame(spark)
    labels = spark.createDataFrame([(i, 0, t) for i in range(30) for t in (0, i % 2, None)] + [(None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.detect_toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    empty = toxicity.detect_toxicity(messy.empty(spark), labels)
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "score", "predicted"]
    without = toxicity.detect_toxicity(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in without} == {0}


@pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")
def test_held_out_documents_of_the_given_tables(spark):
    folder = TESTDATA / "sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.detect_toxicity(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg({"predicted": "avg"}).collect()
    share = {r[0]: r[1] for r in found}
    assert share[1] > 0.85 and share[0] < 0.03


def test_suspects_take_time_in_proportion():
    import time

    for text in ("x" * 3_000_000, "ab" * 1_500_000, "a1" * 300_000, "a " * 300_000, "1" * 1_000_000, re.sub("a", "a!", "a" * 300_000)):
        start = time.perf_counter()
        toxicity.SUSPECT.search(text)
        assert time.perf_counter() - start < 5
