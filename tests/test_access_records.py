"""Access rules, record upserts, checks and permit documents."""

from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stopclock.functions import text as tx
from stopclock.operators import access, permits, records
from stopclock.operators.access import Caller


@pytest.fixture(scope="module")
def people(spark):
    profiles = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, is_admin boolean")
    subs = spark.createDataFrame([("b", "pro", "canceling"), ("c", "free", "active"), ("a", "pro", "expired")], "user_id string, plan string, status string")
    return profiles, subs


@pytest.mark.parametrize(
    ("table", "caller", "expected"),
    [("subscriptions", "a", 3), ("subscriptions", "b", 1), ("subscriptions", "x", 0), ("subscriptions", None, 0),
     ("search_logs", "a", 1), ("analysis_results", "b", 3), ("analysis_results", "c", 0), ("analysis_results", "a", 0),
     ("parcels", "x", 3), ("parcels", None, 0), ("transit_stop_daily", "c", 3), ("deletion_requests", "a", 1), ("unknown", "a", 0)],
)
def test_reading(spark, people, table, caller, expected):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    assert access.visible_rows(df, table, Caller(caller), *people).count() == expected


def test_entitled_users(people):
    assert rows(access.entitled_users(people[1])) == [("b",)]


def test_write_checks(spark, people):
    df = spark.createDataFrame([("a", False), ("b", True), (None, True)], "id string, is_admin boolean")
    accepted, rejected = access.split_writes(access.checked_writes(df, "profiles", "update", Caller("b")))
    assert rows(accepted) == [("b", True)] and rejected.count() == 2
    mine = spark.createDataFrame([("b",)], "user_id string")
    assert access.checked_writes(mine, "search_overrides", "update", Caller("b"), people[0]).first().accepted is False
    assert access.checked_writes(mine, "search_overrides", "insert", Caller("a"), people[0]).first().accepted is True


def test_deletion(spark):
    requests = spark.createDataFrame([(1, "b", "pending", None), (2, "c", "pending", None)], "id int, user_id string, status string, completed_at timestamp")
    done = spark.createDataFrame([(1,)], "id int")
    got = {r.id: (r.status, r.completed_at is not None) for r in access.complete_requests(requests, done, "2026-01-01T00:00:00Z").collect()}
    assert got == {1: ("completed", True), 2: ("pending", False)}
    assert rows(access.purge_users(requests.select("id", "user_id"), spark.createDataFrame([("b",), ("b",)], "user_id string"))) == [(2, "c")]


def test_merge_keeps_what_is_not_supplied(spark):
    stored = spark.createDataFrame([("k1", "o1", 1.0), ("k2", "o2", 2.0)], "cadastral string, owner string, area double")
    new = spark.createDataFrame([("k1", 5.0, 1), ("k1", None, 2), ("k3", 7.0, 1)], "cadastral string, area double, seq int")
    with pytest.raises(Exception, match="need an order"):
        records.merge_records(stored, new.drop("seq"), "cadastral").collect()
    assert rows(records.merge_records(stored, new, "cadastral", "seq")) == [("k1", "o1", None), ("k2", "o2", 2.0), ("k3", None, 7.0)]


def test_replace_groups(spark):
    schema = "cadastral string, owner_name string"
    stored = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c")], schema)
    new = spark.createDataFrame([("k1", "z"), ("k9", "y"), ("k9", "y")], schema)
    assert rows(records.replace_groups(stored, new, "cadastral")) == [("k1", "z"), ("k2", "c"), ("k9", "y"), ("k9", "y")]


@pytest.mark.parametrize(
    ("body", "accepted"),
    [([{"cadastral": "c", "owner_name": "n"}], True), ([], True), ([{"cadastral": 5}], False), ([{"owner_name": "n"}], False),
     ([{"cadastral": "c", "extra": 1}], False), (["c"], False), ([[1]], False), ({"cadastral": "c"}, False), ([{"cadastral": "c"}] * 100, True),
     ([{"cadastral": "c"}] * 101, False), ([{"cadastral": "c"}, None], False), ([{"cadastral": "c", "owner_id": None}], True)],
)
def test_owner_batches(spark, body, accepted):
    df = spark.createDataFrame([(1, json.dumps(body))], "batch_id int, body string")
    assert records.check_owner_batches(df).first().accepted is accepted


@pytest.mark.parametrize(("body", "accepted"), [('{"cadastral": "c", "x": [1]}', True), ('{"cadastral": 1}', False), ('["cadastral"]', False), ("{oops", False), ('"cadastral"', False)])
def test_parcels(spark, body, accepted):
    assert records.check_parcels(spark.createDataFrame([(body,)], "body string")).first().accepted is accepted


def test_decisions(spark):
    nbsp = chr(0xA0)
    page = (f"<p>{tx.LABEL_REGISTERED}:</p><b>3.11.2025</b>&nbsp;{tx.LABEL_ISSUED}{nbsp}{nbsp}12/1/2026 "
            f"<i>{tx.LABEL_RESULT}</i> : დადებითი, end")
    data = [("doc1", page.encode()), ("doc2", b"%PDF-1.7 \xff\xfe"), ("doc3", b"<p>nothing \xff here</p>")]
    got = {r.doc_id: r for r in permits.permit_decisions(spark.createDataFrame(data, "doc_id string, body binary")).collect()}
    assert (got["1"].format, got["1"].registered, got["1"].issued, got["1"].result, got["1"].base64) == ("html", "3/11/2025", "12/1/2026", "დადებითი", None)
    assert (got["2"].format, got["2"].registered, got["2"].base64) == ("pdf", None, "JVBERi0xLjcg//4=")
    assert (got["3"].format, got["3"].registered, got["3"].result) == ("html", "", "")


BS = chr(92)


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        (f"<ul><LI> <b>one{BS}/two<{BS}/b> <{BS}/li><li><{BS}/li><li>{BS}u10D0{BS}u10d1<{BS}/li><{BS}/ul>", "one/two | აბ"),
        (f"<p>{tx.LABEL_NOMENCLATURE} : plain{BS}n{BS}n text {BS}t {BS}{BS}x {BS}" + '"q' + f"{BS}" + '"<p>', f'plain text {BS}t {BS}{BS}x "q"'),
        ("", ""),
    ],
)
def test_details(spark, markup, expected):
    body = f'x;s0.nomenklaturMarkup:"{markup}";code 01.02.03.004.005 and 11.02.03.004.005 and 01.02.03.004.005'
    got = permits.permit_details(spark.createDataFrame([("7", body)], "doc_id string, body string")).first()
    assert got.nomenclature == expected
    assert got.cadastral == ["01.02.03.004.005", "11.02.03.004.005"]


def test_details_without_the_field(spark):
    got = permits.permit_details(spark.createDataFrame([("7", "nothing")], "doc_id string, body string")).first()
    assert (got.nomenclature, got.cadastral) == ("", [])


def test_long_texts(spark):
    body = 'nomenklaturMarkup:"' + "word <br>" * 200_000 + '"'
    df = spark.createDataFrame([("1", body)], "doc_id string, body string")
    assert len(permits.permit_details(df).first().nomenclature) == 5 * 200_000 - 1
    blank = "<p> &nbsp;" * 200_000 + "x"
    assert spark.createDataFrame([(blank,)], "b string").select(tx.plain_text(F.col("b"))).first()[0] == " x"


def test_a_group_can_become_empty(spark):
    stored = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c"), ("k3", "d")], "cadastral string, owner string")
    new = spark.createDataFrame([("k2", "e")], "cadastral string, owner string")
    gone = spark.createDataFrame([("k1",), ("k9",)], "cadastral string")
    assert rows(records.replace_groups(stored, new, "cadastral", gone)) == [("k2", "e"), ("k3", "d")]
