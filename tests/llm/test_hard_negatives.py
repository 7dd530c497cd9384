"""Hard negatives against brute force, on rows with everything that may be odd about them."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from stopclock.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, d long, vec string, aid int, ab int, near int, nth int, rank int, times int, score int"


def table(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    extra = (1, "x", 2, 3, 4, 5, 6, 7, 8)
    base = [rng.uniform(-1, 1) for _ in range(11)]
    out = []
    for i in range(230):
        vector = [b + rng.uniform(-0.4, 0.4) for b in base] if i % 2 else [rng.uniform(-1, 1) for _ in range(11)]
        out.append((i, vector, 1 if i % 3 else i % 5, *extra))
    out += [out[100], out[100], out[40], out[41]]  # repeated rows, an anchor among them
    out += [(300 + i, list(out[7][1]), i % 2, *extra) for i in range(8)]  # ties
    out += [(400, None, 1, *extra), (500, [0.1] * 11, None, *extra), (600, [None] + [0.1] * 10, 1, *extra), (601, [math.nan] * 11, 1, *extra), (602, [math.inf] * 11, 1, *extra)]
    out += [(None, [b * 0.9 for b in base], 1, *extra), (None, [b * 0.9 for b in base], 2, *extra), (700, [], 1, *extra), (701, [1.0, 0.5], 2, *extra), (702, [0.0] * 11, 9, *extra)]
    return out


def brute(table: list[tuple], positives: int = 5, negatives: int = 5) -> list[tuple]:
    rank = lambda i: -(1 << 63) if i is None else i
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y, *_ in table if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, y) in enumerate(good):
        if i is None or i % 100:
            continue
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=False))
        near = sorted((-score(w), rank(j), j) for m, (j, w, z) in enumerate(good) if m != k and z == y)[:positives]
        for s, _, positive in near:
            far = sorted((-score(w), rank(j), j) for j, w, z in good if z != y and 80 * -s <= 100 * score(w) <= 100 * -s)[:negatives]
            out += [(i, positive, n, j, -s, -t) for n, (t, _, j) in enumerate(far, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("anchors, block", [(512, 4096), (2, 16)])
def test_equal_to_brute_force(spark, monkeypatch, anchors, block):
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    data = table()
    found = hardneg.mine_hard_negatives(spark.createDataFrame(data, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0)
    assert rows(found) == brute(data)
    assert len(brute(data)) > 50


def test_empty_and_without_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hardneg.mine_hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame(table(), SCHEMA)
    assert hardneg.mine_hard_negatives(some, F.col("vec_id") < -5).count() == 0
    assert hardneg.mine_hard_negatives(some.where("label = 1"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size, dims", [(1, 1), (200, 64), (40_000, 17), (1 << 26, 9)])
def test_table_scores_are_inner_products(size, dims):
    rng = np.random.default_rng(dims)
    a, c = (rng.integers(-size, size, (n, dims), endpoint=True) for n in (7, 33))
    planes = hardneg.bit_planes(c)
    assert (hardneg.scores(hardneg.subset_sums(a, planes.shape[1]), planes) == c @ a.T).all()


def test_too_large_components_are_an_error():
    planes = hardneg.bit_planes(np.full((2, 4), 1 << 40))
    with pytest.raises(OverflowError):
        hardneg.scores(hardneg.subset_sums(np.full((1, 4), 1 << 40), 1), planes)


def test_plan_has_no_cross_join(spark):
    found = hardneg.mine_hard_negatives(spark.createDataFrame(table(), SCHEMA), F.col("vec_id") % 100 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
