"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from conftest import TESTDATA

SF = str(TESTDATA / "sf0.001")
QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracle_has_no_orphans():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 2
