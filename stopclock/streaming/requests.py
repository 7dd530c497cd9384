"""Request limits over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stopclock.operators.usage import rate_limit_audit

WATERMARK = "10 minutes"


def rate_limit_stream(requests: DataFrame, limit: str | tuple[int, str]) -> DataFrame:
    """Clients over their limit per window; a window closes once the watermark has passed it."""
    return rate_limit_audit(requests.withWatermark("ts", WATERMARK), limit)
