"""Subscription state folded from billing events, trial upkeep and cancellation decisions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.functions.calendar import add_hours
from stopclock.operators.carry import carry_forward

# Fixed values
COMPLETED = "transaction.completed"
ACTIVATED = "subscription.activated"
UPDATED = "subscription.updated"
CANCELED = "subscription.canceled"
PAST_DUE = "subscription.past_due"
PAUSED = "subscription.paused"
EVENT_TYPES = (COMPLETED, ACTIVATED, UPDATED, CANCELED, PAST_DUE, PAUSED)
YEAR_HOURS = 365 * 24
MONTH_HOURS = 30 * 24
REFUND_DAYS = 335
NO_END_DAYS = 999.0
ENTITLED_STATUSES = ("active", "trialing", "canceling")
REMINDERS = (("four_day", 84, 108), ("last_day", 12, 36))  # hours until the trial ends

STATE_COLUMNS = {
    "plan": "string",
    "status": "string",
    "paddle_subscription_id": "string",
    "billing_interval": "string",
    "current_period_end": "timestamp",
    "paddle_customer_id": "string",
    "subscription_started_at": "timestamp",
    "updated_at": "timestamp",
    "trial_active": "boolean",
    "trial_ends_at": "timestamp",
}

SLICE_HOURS = 6
_PRIOR = "0001-01-01T00:00:00Z"


def instant(value: Column | str | dt.datetime) -> Column:
    """A timestamp from a column, an ISO string with zone, or a zoned datetime."""
    if isinstance(value, Column):
        return value
    text = value.isoformat() if isinstance(value, dt.datetime) else value
    return F.lit(text).cast("timestamp")


def _interval_end(start: Column, interval: Column) -> Column:
    """365 days for yearly billing, 30 days for anything else."""
    return F.when(interval == "year", add_hours(start, YEAR_HOURS)).otherwise(add_hours(start, MONTH_HOURS))


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def _assign(condition: Column, value: Column) -> Column:
    """An assignment is a struct, so that an assigned null differs from no assignment."""
    return F.when(condition, F.struct(value.alias("value")))


def _first_item_interval() -> Column:
    item = F.get(F.col("data.items"), F.lit(0))
    return F.coalesce(item["price"]["billing_cycle"]["interval"], F.lit("month"))


def usable_events(events: DataFrame) -> DataFrame:
    """Events of known type that name a user."""
    user = F.col("data.custom_data.user_id")
    return events.where(~_blank(user) & F.col("event_type").isin(*EVENT_TYPES)).withColumn("user_id", user)


def _assignments(events: DataFrame, policy: str) -> DataFrame:
    """Per event, the value it assigns to each column, state-dependent ones left open."""
    kind = F.col("event_type")
    now = F.col("received_at")
    server = policy == "server"
    interval = _first_item_interval()
    start = F.coalesce(F.col("data.started_at"), F.col("data.created_at"), now)
    status = F.col("data.status")
    sub_id = F.col("data.subscription_id")
    period_end = F.col("data.current_billing_period.ends_at")
    is_completed, is_activated, is_updated = kind == COMPLETED, kind == ACTIVATED, kind == UPDATED
    creates = is_completed | is_activated

    default_active = F.when(_blank(status) if server else status.isNull(), F.lit("active")).otherwise(status)
    mapped = F.when((status == "canceled") & (period_end > now), F.lit("canceling")).otherwise(status)
    new_status = (
        F.when(is_completed, _assign(F.lit(True), F.lit("active")))
        .when(is_activated, _assign(F.lit(True), default_active))
        .when(is_updated, _assign(status.isNotNull(), mapped))
        .when(kind == CANCELED, _assign(F.lit(True), F.lit("canceled" if server else "canceling")))
        .when(kind == PAST_DUE, _assign(F.lit(True), F.lit("past_due")))
        .when(kind == PAUSED, _assign(F.lit(True), F.lit("paused")))
    )
    frees = kind.isin(PAUSED, CANCELED) if server else kind == PAUSED
    new_plan = F.when(creates, _assign(F.lit(True), F.lit("pro"))).when(frees, _assign(F.lit(True), F.lit("free")))
    new_end = (
        F.when(is_completed, _assign(_blank(sub_id), F.coalesce(F.col("data.billing_period.ends_at"), F.col("data.next_billed_at"))))
        .when(is_activated, _assign(F.lit(True), _interval_end(start, interval)))
        .when(kind == CANCELED, _assign(F.lit(True), F.coalesce(F.col("data.canceled_at"), period_end)))
    )
    new_id = F.when(is_completed, _assign(F.lit(True), F.coalesce(sub_id, F.col("data.id")))).when(
        is_activated, _assign(F.lit(True), F.col("data.id"))
    )
    touched = F.lit(True) if server else is_updated
    never = F.lit(False)
    return events.select(
        "user_id", "received_at", "event_id",
        creates.alias("creates"),
        is_updated.alias("is_updated"),
        period_end.alias("update_end"),
        F.col("data.id").alias("update_id"),
        new_plan.alias("set_plan"),
        new_status.alias("set_status"),
        new_id.alias("set_paddle_subscription_id"),
        _assign(creates, interval).alias("set_billing_interval"),
        new_end.alias("set_current_period_end"),
        _assign(creates, F.col("data.customer_id")).alias("set_paddle_customer_id"),
        _assign(is_activated, start).alias("set_subscription_started_at"),
        _assign(touched, now).alias("set_updated_at"),
        _assign(never, F.lit(None).cast("boolean")).alias("set_trial_active"),
        _assign(never, F.lit(None).cast("timestamp")).alias("set_trial_ends_at"),
    )


def _prior_rows(current: DataFrame, like: DataFrame) -> DataFrame:
    """Existing rows as assignments of every column, before any event."""
    held = {c: (F.col(c) if c in current.columns else F.lit(None)).cast(t) for c, t in STATE_COLUMNS.items()}
    return current.select(
        "user_id",
        F.lit(_PRIOR).cast("timestamp").alias("received_at"),
        F.lit(None).cast(like.schema["event_id"].dataType).alias("event_id"),
        F.lit(True).alias("creates"),
        F.lit(False).alias("is_updated"),
        F.lit(None).cast("timestamp").alias("update_end"),
        F.lit(None).cast("string").alias("update_id"),
        *[_assign(F.lit(True), value).alias(f"set_{c}") for c, value in held.items()],
    )


def fold_events(events: DataFrame, current: DataFrame | None = None, policy: str = "server") -> DataFrame:
    """Latest subscription row per user after all events, in ``(received_at, event_id)`` order.

    Each column holds the last value assigned to it. Events before the row exists change nothing.
    An ``updated`` event sets the period end only outside the first period, which depends on the
    start and interval stored by then; those are carried along each user's events in time slices,
    so one user's events never have to be in one task, and the final fold combines before its shuffle.
    """
    if policy not in ("server", "edge"):
        raise ValueError(f"unknown policy {policy!r}")
    rows = _assignments(usable_events(events), policy)
    if current is not None:
        rows = rows.unionByName(_prior_rows(current, rows))
    order = ["received_at", "event_id"]
    seen = carry_forward(
        rows,
        keys=["user_id"],
        order=order,
        slice_of=F.floor(F.unix_seconds("received_at") / (SLICE_HOURS * 3600)),
        carried={
            "existed": F.when(F.col("creates"), F.lit(True)),
            "held_start": F.col("set_subscription_started_at"),
            "held_interval": F.col("set_billing_interval"),
        },
    ).where(F.col("creates") | F.col("existed"))

    held_end = _interval_end(F.col("held_start.value"), F.col("held_interval.value"))
    outside = F.col("is_updated") & ~F.coalesce(held_end > F.col("received_at"), F.lit(False))
    seen = seen.withColumn(
        "set_current_period_end",
        F.coalesce(F.col("set_current_period_end"), _assign(outside, F.col("update_end"))),
    )
    if policy == "edge":
        seen = seen.withColumn(
            "set_paddle_subscription_id",
            F.coalesce(
                F.col("set_paddle_subscription_id"),
                _assign(outside & F.col("update_id").isNotNull(), F.col("update_id")),
            ),
        )
    position = F.struct(*order)
    latest = seen.groupBy("user_id").agg(
        *[
            F.max_by(F.col(f"set_{c}"), F.when(F.col(f"set_{c}").isNotNull(), position)).alias(c)
            for c in STATE_COLUMNS
        ]
    )
    return latest.select("user_id", *[F.col(f"{c}.value").alias(c) for c in STATE_COLUMNS])


def marketing_consents(events: DataFrame) -> DataFrame:
    """Last consent each user gave with a completed transaction or an activation."""
    consent = F.col("data.custom_data.marketing_consent")
    return (
        usable_events(events)
        .where(F.col("event_type").isin(COMPLETED, ACTIVATED) & consent.isNotNull())
        .groupBy("user_id")
        .agg(F.max_by(consent, F.struct("received_at", "event_id")).alias("marketing_consent"))
    )


def apply_consents(profiles: DataFrame, consents: DataFrame) -> DataFrame:
    """Profiles with the consent of their user, where one was given; no profile is created."""
    given = consents.select(F.col("user_id").alias("id"), F.col("marketing_consent").alias("given"))
    return profiles.join(given, "id", "left").select(
        *[
            F.coalesce("given", "marketing_consent").alias(c) if c == "marketing_consent" else F.col(c)
            for c in profiles.columns
        ]
    )


def maintenance_action(as_of: Column) -> Column:
    expire = (F.col("status") == "trialing") & (F.col("trial_ends_at") < as_of)
    finish = (F.col("status") == "canceling") & (F.col("current_period_end") < as_of)
    return F.when(expire, "expired").when(finish, "finalized")


def trial_maintenance(subscriptions: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    """Overdue trials become free and expired; ended cancellations become free and canceled."""
    action = F.col("_action")
    marked = subscriptions.withColumn("_action", maintenance_action(instant(as_of)))
    return marked.withColumns(
        {
            "plan": F.when(action.isNotNull(), F.lit("free")).otherwise(F.col("plan")),
            "status": F.when(action == "expired", "expired").when(action == "finalized", "canceled").otherwise(F.col("status")),
            "trial_active": F.when(action == "expired", F.lit(False)).otherwise(F.col("trial_active")),
        }
    ).drop("_action")


def trial_reminders(
    subscriptions: DataFrame, users: DataFrame, as_of: Column | str | dt.datetime
) -> DataFrame:
    """Trials ending in about four days or one day, with the e-mail to write to."""
    now = instant(as_of)
    due = F.lit(None).cast("string")
    for name, first, last in REMINDERS:
        ends = F.col("trial_ends_at")
        due = F.when((ends >= add_hours(now, first)) & (ends < add_hours(now, last)), name).otherwise(due)
    candidates = subscriptions.where(F.col("status") == "trialing").withColumn("reminder", due)
    addressed = users.where(~_blank(F.col("email"))).select("user_id", "email")
    return candidates.where(F.col("reminder").isNotNull()).select("user_id", "trial_ends_at", "reminder").join(
        addressed, "user_id", "inner"
    )


def maintenance_counts(subscriptions: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    """How many rows each upkeep step touches, reminders counted before the address lookup."""
    now = instant(as_of)
    steps = maintenance_action(now)
    for name, first, last in REMINDERS:
        ends = F.col("trial_ends_at")
        window = (F.col("status") == "trialing") & (ends >= add_hours(now, first)) & (ends < add_hours(now, last))
        steps = F.coalesce(steps, F.when(window, name))
    return subscriptions.select(steps.alias("action")).where(F.col("action").isNotNull()).groupBy("action").count()


def cancellation_decisions(
    subscriptions: DataFrame, as_of: Column | str | dt.datetime, policy: str = "server"
) -> DataFrame:
    """When a requested cancellation takes effect and the row it leaves behind.

    Yearly plans within 30 days of their start end at once with a refund. Under the ``server``
    policy trials also end at once, yet their row becomes ``canceling``. The ``edge`` policy
    knows no trials and considers active rows only.
    """
    now = instant(as_of)
    candidates = ["active", "trialing"] if policy == "server" else ["active"]
    rows = subscriptions.where(F.col("status").isin(*candidates) & ~_blank(F.col("paddle_subscription_id")))
    left = (F.unix_micros("current_period_end") - F.unix_micros(now)) / 86_400_000_000.0
    days = F.coalesce(left, F.lit(NO_END_DAYS))
    trial = F.col("status") == "trialing"
    refund = ~trial & F.coalesce(F.col("billing_interval") == "year", F.lit(False)) & (days >= REFUND_DAYS)
    return rows.select(
        "user_id",
        trial.alias("was_trial"),
        days.alias("days_until_end"),
        F.when(trial | refund, "immediately").otherwise("next_billing_period").alias("effective_from"),
        F.when(refund, "canceled").otherwise("canceling").alias("new_status"),
        F.when(refund, "free").otherwise(F.col("plan")).alias("new_plan"),
        F.when(~refund, F.col("paddle_subscription_id")).alias("new_subscription_id"),
    )


def account_view(users: DataFrame, profiles: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per user with profile and subscription; missing or empty values take their defaults."""

    def default(name: str, value: str) -> Column:
        return F.when(_blank(F.col(name)), F.lit(value)).otherwise(F.col(name))

    named = profiles.select(F.col("id").alias("user_id"), "full_name", "avatar_url")
    subs = subscriptions.select("user_id", "plan", "status", "billing_interval", "current_period_end")
    return (
        users.select("user_id", "email").join(named, "user_id", "left").join(subs, "user_id", "left")
        .select(
            "user_id", "email",
            F.coalesce("full_name", F.lit("")).alias("name"),
            F.nullif("avatar_url", F.lit("")).alias("avatar_url"),
            default("plan", "free").alias("plan"),
            default("status", "free").alias("status"),
            default("billing_interval", "month").alias("billing_interval"),
            F.col("current_period_end").alias("period_end"),
        )
    )
