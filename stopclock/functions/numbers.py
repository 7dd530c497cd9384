"""Rounding and order statistics whose results do not depend on the engine's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# percentile_disc picks the value at position ceil(q * n); adding this to p moves it
# to floor(p * n) + 1 for every n up to about 1e10, with p given to two decimals.
_NEXT_POSITION = 1e-12


def half_up(value: Column, decimals: int = 0) -> Column:
    """Round halves toward +infinity (Spark's ``round`` moves them away from zero)."""
    if decimals == 0:
        return F.floor(value + F.lit(0.5))
    scale = float(10**decimals)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def median(name: str) -> Column:
    """Mean of the two middle values; null when every value is null.

    For whole-number columns with a bounded range: the aggregation buffer then holds
    one counter per distinct value and is combined before the shuffle. Columns of
    arbitrary doubles go through :mod:`stopclock.operators.quantiles`.
    """
    return F.percentile(F.col(name), F.lit(0.5))


def index_percentile(name: str, p: float) -> Column:
    """The sorted value at zero-based index ``min(n - 1, floor(p * n))``.

    This is neither ``percentile_cont`` nor ``percentile_disc``, but the latter gives it
    when asked for a point just above ``p``. Same bounded-range rule as :func:`median`.
    """
    q = repr(p + _NEXT_POSITION)
    return F.expr(f"percentile_disc({q}D) WITHIN GROUP (ORDER BY {name})")
