"""Subscription folding, upkeep and cancellation."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stopclock.operators import subscriptions as subs
from stopclock.sources.schemas import BILLING_EVENT

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def at(days):
    return T0 + dt.timedelta(days=days)


def event(day, kind, user="u", eid=None, interval=None, consent=None, **data):
    full = dict.fromkeys(
        "id subscription_id status customer_id started_at created_at canceled_at next_billed_at billing_period "
        "current_billing_period items custom_data".split()
    )
    full.update(data)
    for period in ("billing_period", "current_billing_period"):
        if full[period] is not None:
            full[period] = {"ends_at": full[period]}
    full["items"] = [{"price": {"billing_cycle": {"interval": interval}}}] if interval else None
    full["custom_data"] = {"user_id": user, "marketing_consent": consent}
    return (eid or f"{day:09.3f}", at(day), kind, full)


def fold(spark, events, current=None, policy="server"):
    df = spark.createDataFrame(events, BILLING_EVENT)
    return {r.user_id: r for r in subs.fold_events(df, current, policy).collect()}


def utc(value):
    return value.replace(tzinfo=dt.UTC) if value is not None and value.tzinfo is None else value


def same_instant(spark, value, expected):
    return value is not None and abs(value.astimezone(dt.UTC) - expected) < dt.timedelta(milliseconds=1)


def test_activation_sets_the_period_from_the_start(spark):
    got = fold(spark, [event(3, subs.ACTIVATED, id="s1", interval="year", started_at=at(1), customer_id="c", status="")])["u"]
    assert (got.plan, got.status, got.paddle_subscription_id, got.billing_interval) == ("pro", "active", "s1", "year")
    assert same_instant(spark, got.current_period_end, at(366)) and same_instant(spark, got.subscription_started_at, at(1))


def test_update_inside_and_outside_the_first_period(spark):
    start = event(0, subs.ACTIVATED, id="s1", started_at=at(0))
    inside = event(10, subs.UPDATED, status="active", current_billing_period=at(50))
    outside = event(31, subs.UPDATED, status="active", current_billing_period=at(61))
    assert same_instant(spark, fold(spark, [start, inside])["u"].current_period_end, at(30))
    assert same_instant(spark, fold(spark, [start, inside, outside])["u"].current_period_end, at(61))


def test_update_can_assign_a_null_end(spark):
    got = fold(spark, [event(0, subs.ACTIVATED, started_at=at(-40)), event(1, subs.UPDATED, status="active")])["u"]
    assert got.current_period_end is None


def test_scheduled_cancel_becomes_canceling(spark):
    start = event(0, subs.ACTIVATED)
    assert fold(spark, [start, event(1, subs.UPDATED, status="canceled", current_billing_period=at(9))])["u"].status == "canceling"
    assert fold(spark, [start, event(10, subs.UPDATED, status="canceled", current_billing_period=at(9))])["u"].status == "canceled"


def test_transactions(spark):
    one_off = event(0, subs.COMPLETED, id="t1", billing_period=at(20), next_billed_at=at(25))
    got = fold(spark, [one_off])["u"]
    assert (got.paddle_subscription_id, got.billing_interval) == ("t1", "month") and same_instant(spark, got.current_period_end, at(20))
    renewal = event(1, subs.COMPLETED, id="t2", subscription_id="s9", billing_period=at(99), interval="year")
    got = fold(spark, [one_off, renewal])["u"]
    assert (got.paddle_subscription_id, got.billing_interval) == ("s9", "year") and same_instant(spark, got.current_period_end, at(20))


def test_updates_do_not_create_rows(spark):
    events = [event(0, subs.PAUSED), event(1, subs.UPDATED, status="active"), event(2, "something.else"), event(3, subs.ACTIVATED, user="")]
    assert fold(spark, events) == {}


def test_pause_and_past_due(spark):
    got = fold(spark, [event(0, subs.ACTIVATED), event(1, subs.PAST_DUE)])["u"]
    assert (got.plan, got.status) == ("pro", "past_due")
    got = fold(spark, [event(0, subs.ACTIVATED), event(1, subs.PAUSED)])["u"]
    assert (got.plan, got.status) == ("free", "paused")


def test_policies_differ(spark):
    events = [event(0, subs.ACTIVATED, id="s1", started_at=at(-40)), event(1, subs.UPDATED, id="s2", status="active"), event(2, subs.CANCELED, canceled_at=at(2))]
    server, edge = fold(spark, events)["u"], fold(spark, events, policy="edge")["u"]
    assert (server.plan, server.status, server.paddle_subscription_id) == ("free", "canceled", "s1")
    assert (edge.plan, edge.status, edge.paddle_subscription_id) == ("pro", "canceling", "s2")
    assert same_instant(spark, server.updated_at, at(2)) and same_instant(spark, edge.updated_at, at(1))


def test_existing_rows_take_part(spark):
    current = spark.createDataFrame(
        [("u", "pro", "trialing", "s0", at(0), "year", True, at(14)), ("idle", "free", "expired", None, None, None, False, None)],
        "user_id string, plan string, status string, paddle_subscription_id string, subscription_started_at timestamp, "
        "billing_interval string, trial_active boolean, trial_ends_at timestamp")
    got = fold(spark, [event(100, subs.UPDATED, status="active", current_billing_period=at(500))], current)
    assert got["u"].status == "active" and got["u"].current_period_end is None and got["u"].trial_active
    assert got["idle"].status == "expired" and got["idle"].current_period_end is None


def random_events(n, users):
    rng = random.Random(7)
    kinds = list(subs.EVENT_TYPES)
    out = []
    for i in range(n):
        day = rng.random() * 200
        out.append(event(day, rng.choice(kinds), user=f"u{rng.randrange(users)}", eid=f"e{i:05d}", interval=rng.choice(["year", "month", None]),
                         id=f"o{i}", subscription_id=rng.choice([None, f"s{i}"]), status=rng.choice(["active", "canceled"]),
                         started_at=at(day - rng.random() * 60), current_billing_period=at(day + rng.random() * 60 - 30),
                         billing_period=at(day + 30), consent=rng.choice([True, False, None])))
    return out


@pytest.mark.parametrize("policy", ["server", "edge"])
def test_splitting_events_into_batches_changes_nothing(spark, policy):
    events = sorted(random_events(400, 5), key=lambda e: (e[1], e[0]))
    df = spark.createDataFrame(events, BILLING_EVENT)
    whole = rows(subs.fold_events(df, policy=policy))
    first = subs.fold_events(spark.createDataFrame(events[:190], BILLING_EVENT), policy=policy)
    assert rows(subs.fold_events(spark.createDataFrame(events[190:], BILLING_EVENT), first, policy)) == whole
    assert rows(subs.fold_events(df.repartition(7, "event_id"), policy=policy)) == whole


def test_slices_do_not_change_the_fold(spark, monkeypatch):
    df = spark.createDataFrame(random_events(300, 3), BILLING_EVENT)
    fine = rows(subs.fold_events(df))
    monkeypatch.setattr(subs, "SLICE_HOURS", 24 * 10_000)
    assert rows(subs.fold_events(df)) == fine


def test_consents(spark):
    events = [event(0, subs.ACTIVATED, consent=True), event(1, subs.COMPLETED, consent=False), event(2, subs.COMPLETED), event(3, subs.PAUSED, consent=True)]
    given = subs.marketing_consents(spark.createDataFrame(events, BILLING_EVENT))
    assert rows(given) == [("u", False)]
    profiles = spark.createDataFrame([("u", True), ("w", True)], "id string, marketing_consent boolean")
    assert rows(subs.apply_consents(profiles, given)) == [("u", False), ("w", True)]


def table(spark, data):
    names = "user_id string, plan string, status string, trial_active boolean, trial_ends_at timestamp, current_period_end timestamp, billing_interval string, paddle_subscription_id string"
    return spark.createDataFrame(data, names)


def test_maintenance(spark):
    df = table(spark, [
        ("late", "pro", "trialing", True, at(-1), None, None, None), ("edge", "pro", "trialing", True, at(0), None, None, None),
        ("ended", "pro", "canceling", False, None, at(-1), None, None), ("open", "pro", "canceling", False, None, None, None, None),
    ])
    got = {r.user_id: (r.plan, r.status, r.trial_active) for r in subs.trial_maintenance(df, T0).collect()}
    assert got == {"late": ("free", "expired", False), "edge": ("pro", "trialing", True),
                   "ended": ("free", "canceled", False), "open": ("pro", "canceling", False)}


def test_reminders(spark):
    df = table(spark, [(n, "pro", "trialing", True, at(d), None, None, None) for n, d in
                       (("a", 3.5), ("b", 4.5), ("c", 0.5), ("d", 1.5), ("e", 4.0))])
    users = spark.createDataFrame([(n, f"{n}@x") for n in "abcd"] + [("e", None)], "user_id string, email string")
    assert {(r.user_id, r.reminder) for r in subs.trial_reminders(df, users, T0).collect()} == {("a", "four_day"), ("c", "last_day")}
    assert rows(subs.maintenance_counts(df, T0)) == [("four_day", 2), ("last_day", 1)]


@pytest.mark.parametrize(
    ("status", "interval", "days", "expected"),
    [("active", "year", 335, ("immediately", "canceled", "free", None)), ("active", "year", 334.9, ("next_billing_period", "canceling", "pro", "s")),
     ("active", "month", 400, ("next_billing_period", "canceling", "pro", "s")), ("trialing", "year", 400, ("immediately", "canceling", "pro", "s")),
     ("active", "year", None, ("immediately", "canceled", "free", None))],
)
def test_cancellation(spark, status, interval, days, expected):
    df = table(spark, [("u", "pro", status, False, None, at(days) if days is not None else None, interval, "s")])
    got = subs.cancellation_decisions(df, T0).first()
    assert (got.effective_from, got.new_status, got.new_plan, got.new_subscription_id) == expected


def test_cancellation_candidates(spark):
    df = table(spark, [("a", "pro", "trialing", True, None, None, None, "s"), ("b", "pro", "active", False, None, None, None, None), ("c", "pro", "paused", False, None, None, None, "s")])
    assert [r.user_id for r in subs.cancellation_decisions(df, T0).collect()] == ["a"]
    assert subs.cancellation_decisions(df, T0, "edge").count() == 0


def test_account_defaults(spark):
    users = spark.createDataFrame([("u", "u@x")], "user_id string, email string")
    profiles = spark.createDataFrame([("u", None, "")], "id string, full_name string, avatar_url string")
    current = table(spark, [("u", "", "", False, None, None, "", "s")])
    got = subs.account_view(users, profiles, current).first()
    assert tuple(got) == ("u", "u@x", "", None, "free", "free", "month", None)
    assert subs.account_view(users, profiles, current.where(F.lit(False))).first().plan == "free"
