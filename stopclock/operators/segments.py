"""Traversal speeds by stretch of a route, and their weekly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.functions.calendar import LOCAL_OFFSET_HOURS, hour_band, iso_week, local_hour
from stopclock.functions.geo import haversine_m, squared_degrees
from stopclock.operators.network import Network
from stopclock.operators.quantiles import histogram, merge_histograms, rounded_quantiles
from stopclock.operators.traces import speed_kmh

# Fixed values
MAX_SPEED_KMH = 65.0
MIN_MOVE_M = 15.0
MAX_ADVANCE_M = 3000.0
BIN_M = 150.0
MIN_SAMPLES = 3
SPEED_DECIMALS = 1
LOW_PERCENTILE = 0.15

GROUP_KEYS = ["iso_week", "route_id", "direction", "bin_idx", "band"]
TABLE_COLUMNS = [*GROUP_KEYS, "n", "speed_med_kmh", "speed_p15_kmh"]


def locate_along(samples: DataFrame, network: Network) -> DataFrame:
    """Adds ``along_m``: the running length at the nearest vertex, the first one on ties.

    Each sample looks only at the vertices its cell can be nearest to. Samples off every
    listed cell, far from the line, look at the whole line; only they are joined with whole lines.
    Null where there is no line.
    """
    cell_deg = network.cell_deg
    placed = samples.withColumn("cell_x", F.floor(F.col("lon") / cell_deg)).withColumn(
        "cell_y", F.floor(F.col("lat") / cell_deg)
    )
    lines = network.vertices.groupBy("model_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "lat", "lon", "cum_m"))).alias("line")
    )
    cells = ["model_id", "cell_x", "cell_y"]
    beside = placed.join(network.cells.select(*cells, F.col("near").alias("line")), cells)
    strays = placed.join(network.cells.select(*cells), cells, "left_anti").join(lines, "model_id", "left")
    looked = beside.unionByName(strays)
    nearest = F.array_min(
        F.transform(
            "line",
            lambda v: F.struct(
                squared_degrees(v["lat"], v["lon"], F.col("lat"), F.col("lon")).alias("d"),
                v["idx"].alias("idx"),
                v["cum_m"].alias("cum_m"),
            ),
        )
    )
    return looked.withColumn("along_m", nearest["cum_m"]).select(*samples.columns, "along_m")


def traversals(pairs: DataFrame, offset_hours: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """Speed of each plausible forward pair, repeated for every 150 m bin it covers.

    Expects ``a_along_m`` and ``b_along_m``. The band comes from the earlier sample, the
    week from the service date.
    """
    moved = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    advance = F.col("b_along_m") - F.col("a_along_m")
    kept = (
        pairs.withColumn("moved_m", moved)
        .withColumn("kmh", speed_kmh(F.col("moved_m"), F.col("dt_ms")))
        .where((F.col("kmh") <= MAX_SPEED_KMH) & (F.col("moved_m") > MIN_MOVE_M))
        .where((advance > 0) & (advance < MAX_ADVANCE_M))
    )
    first_bin = F.floor(F.col("a_along_m") / BIN_M).cast("int")
    last_bin = F.floor(F.col("b_along_m") / BIN_M).cast("int")
    return kept.select(
        "service_date",
        iso_week(F.col("service_date")).alias("iso_week"),
        "route_id", "direction",
        F.explode(F.sequence(first_bin, last_bin)).alias("bin_idx"),
        hour_band(local_hour(F.col("a_ts_ms"), offset_hours)).alias("band"),
        "kmh",
    )


def speed_histogram(speeds: DataFrame) -> DataFrame:
    """Mergeable daily counts of speeds: the stored form the weekly tables are built from."""
    return histogram(speeds, ["service_date", *GROUP_KEYS], "kmh", SPEED_DECIMALS)


def _speed_table(hist: DataFrame, keys: list[str]) -> DataFrame:
    table = rounded_quantiles(
        hist, keys, SPEED_DECIMALS, "speed_med_kmh", {"speed_p15_kmh": LOW_PERCENTILE}
    )
    return table.where(F.col("n") >= MIN_SAMPLES)


def segment_daily(hist: DataFrame) -> DataFrame:
    """Speeds of each service day; stretches with fewer than three samples are dropped."""
    return _speed_table(hist, ["service_date", *GROUP_KEYS])


def segment_weekly(hist: DataFrame, mode: str = "last_day") -> DataFrame:
    """Weekly speeds from daily histograms.

    ``last_day``: the latest day's row stands for the week, key by key.
    ``merge``: all traversals of the week together.
    """
    if mode == "merge":
        return _speed_table(merge_histograms(hist, GROUP_KEYS), GROUP_KEYS).select(*TABLE_COLUMNS)
    if mode != "last_day":
        raise ValueError(f"unknown mode {mode!r}")
    values = [c for c in TABLE_COLUMNS if c not in GROUP_KEYS]
    return (
        segment_daily(hist)
        .groupBy(*GROUP_KEYS)
        .agg(F.max_by(F.struct(*values), "service_date").alias("last"))
        .select(*GROUP_KEYS, "last.*")
    )
