"""Request limits, monthly activity and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
RATE_LIMITS = {"api": (120, "15 minutes"), "strict": (20, "15 minutes"), "webhook": (200, "1 minute")}
FEATURES = ("map_click", "free_analysis", "pro_analysis", "relief_analysis", "pdf_export", "geojson_export")
FREE_TOKENS, TRIAL_TOKENS, PRO_TOKENS = 50, 300, 1000
WARN_SHARE = 0.9


def rate_limit_audit(requests: DataFrame, limit: str | tuple[int, str]) -> DataFrame:
    """Clients over their limit per fixed window: ``client, window_start, n, rejected``.

    Windows are aligned to the epoch. Works on batch and streaming input alike.
    """
    most, width = RATE_LIMITS[limit] if isinstance(limit, str) else limit
    return (
        requests.groupBy("client", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > most)
        .select("client", F.col("w.start").alias("window_start"), "n", (F.col("n") - most).alias("rejected"))
    )


def monthly_activity(usage: DataFrame, features: tuple[str, ...] | None = FEATURES) -> DataFrame:
    """Uses per user, month and feature. ``features=None`` counts every feature name."""
    rows = usage if features is None else usage.where(F.col("feature").isin(*features))
    return rows.groupBy("user_id", F.trunc("ts", "month").alias("month"), "feature").agg(F.count("*").alias("uses"))


def plan_limit(plan: Column, status: Column) -> Column:
    return (
        F.when(status == "trialing", TRIAL_TOKENS)
        .when(plan == "pro", PRO_TOKENS)
        .otherwise(FREE_TOKENS)
    )


def quota_status(activity: DataFrame, subscriptions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Monthly tokens used against the plan's or the user's own limit.

    ``warn`` from 90 % of the limit on; ``exceeded`` once nothing is left.
    """
    used = activity.groupBy("user_id", "month").agg(F.sum("uses").alias("used"))
    subs = subscriptions.select("user_id", plan_limit(F.col("plan"), F.col("status")).alias("plan_limit"))
    own = overrides.select("user_id", "monthly_limit")
    limit = F.coalesce("monthly_limit", "plan_limit", F.lit(FREE_TOKENS)).cast("long")
    return (
        used.join(subs, "user_id", "left").join(own, "user_id", "left")
        .select("user_id", "month", "used", limit.alias("monthly_limit"))
        .withColumn("remaining", F.greatest(F.col("monthly_limit") - F.col("used"), F.lit(0)))
        .withColumn("warn", F.col("used") >= F.col("monthly_limit") * WARN_SHARE)
        .withColumn("exceeded", F.col("used") >= F.col("monthly_limit"))
    )
