"""The pipeline: every stage on what the stage before has kept."""

from __future__ import annotations

import pytest

import corpus_pipeline
from conftest import TESTDATA
from llm import messy
from stopclock.llm.shared import output_folder

SF = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, root = {"input": docs}, output_folder(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_return_the_columns_of_documents(outputs):
    for name in list(outputs)[:-1]:
        assert outputs[name].columns == outputs["input"].columns


def test_token_stage_collects_no_records_in_the_driver(spark, outputs):
    """Sequences are as many as the corpus has; none of its two last tables may be broadcast, whatever size the planner takes them for."""
    out = corpus_pipeline.materialised(spark, outputs["mix"], SF)
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "[slot#" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, outputs["tokens"].select(out.columns).collect()))


def test_language_keeps_all_text(outputs):
    assert rows(outputs["language"]) == {i: t for i, t in rows(outputs["input"]).items() if t and any(map(str.isalpha, t))}


def test_near_dedup_keeps_the_least_id_of_each_group(outputs):
    before = rows(outputs["language"])
    component = messy.near_components(list(before.items()), 80, 5)
    assert rows(outputs["near_dedup"]) == {i: t for i, t in before.items() if component[i] == i}


def test_decontamination_leaves_no_window(spark, outputs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = rows(outputs["near_dedup"]), rows(outputs["decontaminate"])
    report = {r[0]: r for r in messy.contaminated(list(before.items()), items, 10)}
    assert set(after) == {i for i, r in report.items() if r[2] <= 0.5 * r[1]}
    assert all(after[i] == before[i] for i in after if not report[i][5])
    assert any(after[i] != before[i] for i in after)


def test_mixing_drops_nothing_here_and_tokens_cover_all(outputs):
    assert rows(outputs["mix"]) == rows(outputs["decontaminate"])  # no source is above the cap
    assert {r["doc_id"] for r in outputs["tokens"].select("doc_id").collect()} == set(rows(outputs["mix"]))


def test_run_gives_the_rows_of_the_stages(spark, outputs):
    found = corpus_pipeline.run(spark, SF)
    assert sorted(found.columns) == sorted(outputs["tokens"].columns) and found.count() == outputs["tokens"].count()
