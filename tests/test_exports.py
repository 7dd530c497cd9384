"""Exports hold every stop with statistics and a position."""

from __future__ import annotations

import json

import pytest

from conftest import TESTDATA
from stopclock.plans import catalog
from stopclock.sources import tables

SF = str(TESTDATA / "sf0.001")


@pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")
def test_every_stop_with_statistics_is_exported(spark):
    found = {(r["stop_id"], r["n_obs"]): r["lon"] for r in catalog.exported_features(spark, SF).collect()}
    stats = catalog.queries()["exported_csv"](spark, SF).select("stop_id", "n_obs").collect()
    assert found == {(r["stop_id"], r["n_obs"]): int(r["stop_id"][1:]) + 44.5 for r in stats}
    assert {stop for stop, _ in found} == {"S0", "S1", "S2"}


def test_a_stop_without_a_position_has_no_feature(spark):
    stats = spark.createDataFrame([("A", 1), ("B", 2)], "stop_id string, n_obs long")
    stops = spark.createDataFrame([("A", 41.7, 44.5), ("C", 41.7, 44.5)], "stop_id string, lat double, lon double")
    features = [json.loads(r["value"]) for r in tables.stop_features(stats, stops).collect()]
    assert [f["properties"]["stop_id"] for f in features] == ["A"]
