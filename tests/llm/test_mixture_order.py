"""The pipeline's mixture: every document stays, in an order in which large sources don't crowd out the others."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline


def table(spark, sources):
    rows = [(i, f"text {i}", s) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows + rows[:3] + [(None, None, None)] * 2, "doc_id long, text string, source string").repartition(5)


def mixed(spark, docs):
    return corpus_pipeline.mixed(spark, docs, "")


@pytest.mark.parametrize("hot", [0, 2, 3])
def test_every_document_stays(spark, hot):
    docs = table(spark, ["hot" if hot and i % hot == 0 else f"s{i % 10}" for i in range(6000)])
    out = mixed(spark, docs)
    assert out.columns == docs.columns
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(map(tuple, docs.collect()))


def test_a_hot_source_keeps_to_the_cap_while_others_last(spark):
    sources = ["hot" if i % 2 else f"s{i // 2 % 10}" for i in range(20_000)]
    order = [r["source"] for r in mixed(spark, table(spark, sources)).collect()]
    ahead = collections.Counter(order[:8000])
    assert abs(ahead["hot"] / 8000 - corpus_pipeline.SOURCE_CAP) < 0.02
    assert all(abs(ahead[f"s{k}"] / 8000 - 0.08) < 0.02 for k in range(10))
    assert collections.Counter(order)["hot"] == 10_001 and set(order[-4000:]) <= {"hot", None}


def test_few_sources_are_scheduled_too(spark):
    order = [r["source"] for r in mixed(spark, table(spark, ["a"] * 4000 + ["b"] * 2000)).collect()]
    assert abs(order[:1500].count("a") / 1500 - 2 / 3) < 0.05


def test_no_documents(spark):
    docs = table(spark, ["a"]).where("false")
    assert mixed(spark, docs).columns == docs.columns and mixed(spark, docs).count() == 0


def test_shares_hold_in_the_shards(spark):
    """The token stage reads the mixture's files and keeps its order in the large."""
    from stopclock.llm import tokens
    from stopclock.llm.shared import output_folder

    sources = ["hot" if i % 2 else f"s{i // 2 % 10}" for i in range(20_000)]
    path = output_folder(spark, "mixed")
    mixed(spark, table(spark, sources)).write.parquet(path)
    docs = spark.read.parquet(path)
    out = tokens.training_order(docs, output_folder(spark, "tokens"), key=1, window=500, per_shard=1000)
    source = {i: s for i, s in enumerate(sources)}
    shards = collections.defaultdict(collections.Counter)
    for r in out.collect():
        shards[r["shard"]][source.get(r["doc_id"])] += 1
    assert 20 <= len(shards) <= 22
    for k in range(8):
        total = sum(shards[k].values())
        assert abs(shards[k]["hot"] / total - corpus_pipeline.SOURCE_CAP) < 0.03, k
        assert all(abs(shards[k][f"s{s}"] / total - 0.08) < 0.03 for s in range(10))
