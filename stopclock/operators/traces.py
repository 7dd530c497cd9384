"""Vehicle traces: valid samples and consecutive sample pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
MAX_GAP_MS = 360_000

TRACE_KEYS = ["service_date", "vehicle_id", "route_id", "pattern_suffix"]
# Equal instants are ordered by position and next stop, so reruns agree.
SAMPLE_ORDER = ["ts_ms", "lat", "lon", "next_stop_id"]
SAMPLE_COLUMNS = [*TRACE_KEYS, *SAMPLE_ORDER]

SLICE_MS = 3_600_000


def valid_samples(samples: DataFrame) -> DataFrame:
    """Samples with a vehicle id, a full position and a readable time.

    An empty next stop counts as none.
    """
    return samples.where(
        (F.col("vehicle_id") != "")
        & F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
        & F.col("ts_ms").isNotNull()
    ).withColumn("next_stop_id", F.when(F.col("next_stop_id") != "", F.col("next_stop_id")))


def slices_reached(time: Column, horizon_ms: int, slice_ms: int) -> Column:
    """The slice of an instant and all slices within the horizon after it."""
    return F.sequence(F.floor(time / slice_ms), F.floor((time + horizon_ms) / slice_ms))


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str],
    horizon_ms: int,
    slice_ms: int,
) -> DataFrame:
    """Adds ``prev``, the preceding row of the key, for rows at most ``horizon_ms`` apart.

    ``order[0]`` is the time column. A key is cut into time slices so that no task ever
    sorts a whole hot key; a row is also sent to every later slice that the horizon reaches, where it
    serves only as predecessor. Every pair no further apart than the horizon is found for any slice
    length (slices shorter than the horizon copy rows more often); for wider gaps ``prev`` may be
    null, so callers filter on the gap.
    """
    time = order[0]
    spread = df.withColumn("slice", F.explode(slices_reached(F.col(time), horizon_ms, slice_ms)))
    within = Window.partitionBy(*keys, "slice").orderBy(*order)
    return (
        spread.withColumn("prev", F.lag(F.struct(*carry)).over(within))
        .where(F.col("slice") == F.floor(F.col(time) / slice_ms))
        .drop("slice")
    )


def sample_pairs(
    samples: DataFrame,
    extra_keys: list[str] | None = None,
    extra_carry: list[str] | None = None,
    max_gap_ms: int = MAX_GAP_MS,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Consecutive samples of a trace, gap above zero and at most six minutes.

    ``extra_keys`` are columns constant within a trace; ``extra_carry`` are further
    columns wanted from both samples. Output: the keys, ``a_*``, ``b_*`` and ``dt_ms``.
    """
    extra_keys = extra_keys or []
    carry = [*SAMPLE_ORDER, *(extra_carry or [])]
    paired = with_previous(
        samples.select(*TRACE_KEYS, *extra_keys, *carry),
        TRACE_KEYS, SAMPLE_ORDER, carry, max_gap_ms, slice_ms,
    )
    gap = F.col("ts_ms") - F.col("prev.ts_ms")
    return paired.where((gap > 0) & (gap <= max_gap_ms)).select(
        *TRACE_KEYS,
        *extra_keys,
        *[F.col(f"prev.{c}").alias(f"a_{c}") for c in carry],
        *[F.col(c).alias(f"b_{c}") for c in carry],
        gap.alias("dt_ms"),
    )


def assign_model(samples: DataFrame, patterns: DataFrame) -> DataFrame:
    """Direction and model of each sample; samples of unknown patterns are dropped."""
    return samples.join(patterns, ["service_date", "route_id", "pattern_suffix"], "inner")


def speed_kmh(metres: Column, ms: Column) -> Column:
    return (metres / 1000.0) / (ms / 3_600_000.0)
