"""Row access rules as filters, write checks and deletion requests."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.operators.subscriptions import ENTITLED_STATUSES, instant

# Who may read, change or add rows of each table. A row is visible when any rule allows it.
OWN_ID, OWN_USER, ADMIN, SIGNED_IN, ENTITLED = "own:id", "own:user_id", "admin", "signed_in", "entitled"
READ_RULES = {
    "profiles": (OWN_ID, ADMIN),
    "subscriptions": (OWN_USER, ADMIN),
    "feature_usage": (OWN_USER, ADMIN),
    "search_logs": (OWN_USER,),
    "search_overrides": (OWN_USER, ADMIN),
    "deletion_requests": (OWN_USER,),
    "analysis_results": (ENTITLED,),
    "parcels": (ADMIN, SIGNED_IN),
    "owner_ids": (SIGNED_IN,),
    "transit_stop_daily": (SIGNED_IN,),
    "transit_stop_hourly": (SIGNED_IN,),
    "transit_segment_weekly": (SIGNED_IN,),
    "transit_derive_log": (SIGNED_IN,),
}
UPDATE_RULES = {
    "profiles": (OWN_ID,),
    "subscriptions": (ADMIN,),
    "search_overrides": (ADMIN,),
    "deletion_requests": (ADMIN,),
}
INSERT_RULES = {"search_overrides": (ADMIN,), "search_logs": (OWN_USER,)}
DELETE_RULES = {"search_overrides": (ADMIN,)}
RULES = {"select": READ_RULES, "update": UPDATE_RULES, "insert": INSERT_RULES, "delete": DELETE_RULES}


@dataclass(frozen=True)
class Caller:
    """Who asks: a user id, or None when not signed in."""

    uid: str | int | None

    @property
    def signed_in(self) -> bool:
        return self.uid is not None


def is_admin(profiles: DataFrame, caller: Caller) -> Column:
    """The caller's admin flag as a scalar subquery; false where there is no profile or no flag."""
    flag = profiles.where(F.col("id") == F.lit(caller.uid)).select(F.max("is_admin"))
    return F.coalesce(flag.scalar(), F.lit(False))


def is_entitled(subscriptions: DataFrame, caller: Caller) -> Column:
    """Whether the caller holds a pro subscription in force. It does not depend on the protected row."""
    held = subscriptions.where(
        (F.col("user_id") == F.lit(caller.uid))
        & (F.col("plan") == "pro")
        & F.col("status").isin(*ENTITLED_STATUSES)
    )
    return held.select(F.count("*") > 0).scalar()


def allowed(
    table: str, command: str, caller: Caller,
    profiles: DataFrame | None = None, subscriptions: DataFrame | None = None,
) -> Column:
    """The rules of a table as one condition; no rule means no row."""
    condition = F.lit(False)
    if not caller.signed_in:
        return condition
    for rule in RULES[command].get(table, ()):
        if rule == SIGNED_IN:
            return F.lit(True)
        if rule.startswith("own:"):
            condition = condition | (F.col(rule.removeprefix("own:")) == F.lit(caller.uid))
        elif rule == ADMIN:
            condition = condition | is_admin(profiles, caller)
        elif rule == ENTITLED:
            condition = condition | is_entitled(subscriptions, caller)
    return condition


def visible_rows(
    df: DataFrame, table: str, caller: Caller,
    profiles: DataFrame | None = None, subscriptions: DataFrame | None = None,
) -> DataFrame:
    return df.where(allowed(table, "select", caller, profiles, subscriptions))


def entitled_users(subscriptions: DataFrame) -> DataFrame:
    """Users holding a pro subscription in force."""
    return (
        subscriptions.where((F.col("plan") == "pro") & F.col("status").isin(*ENTITLED_STATUSES))
        .select("user_id").distinct()
    )


def checked_writes(
    rows: DataFrame, table: str, command: str, caller: Caller, profiles: DataFrame | None = None
) -> DataFrame:
    """Adds ``accepted``: whether the written row passes the table's check for the command.

    The profile check compares ids only, so a user can still set their own admin flag; that is
    the rule as it stands.
    """
    verdict = allowed(table, command, caller, profiles)
    return rows.withColumn("accepted", F.coalesce(verdict, F.lit(False)))


def split_writes(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    return (
        checked.where(F.col("accepted")).drop("accepted"),
        checked.where(~F.col("accepted")).drop("accepted"),
    )


def complete_requests(
    requests: DataFrame, done: DataFrame, completed_at: Column | str | dt.datetime
) -> DataFrame:
    """Marks the deletion requests named in ``done`` (id) as completed."""
    named = done.select("id").distinct().withColumn("_done", F.lit(True))
    return requests.join(named, "id", "left").select(
        *[
            F.when(F.col("_done"), F.lit("completed")).otherwise(F.col(c)).alias(c) if c == "status"
            else F.when(F.col("_done"), instant(completed_at)).otherwise(F.col(c)).alias(c) if c == "completed_at"
            else F.col(c)
            for c in requests.columns
        ]
    )


def purge_users(df: DataFrame, users: DataFrame, column: str = "user_id") -> DataFrame:
    """Rows of users who were not deleted."""
    gone = users.select(F.col("user_id").alias(column)).distinct()
    return df.join(gone, column, "left_anti").select(*df.columns)
