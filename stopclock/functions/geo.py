"""Distances, encoded polylines, map tiles and terrain classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
EARTH_RADIUS_M = 6_371_000.0
MERCATOR_RADIUS_M = 6_378_137.0
POLYLINE_SCALE = 1e5
SLOPE_LIMITS = ((3.0, "flat"), (8.0, "gentle"), (15.0, "moderate"), (30.0, "steep"))
STEEPEST = "very_steep"
ASPECT_SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
SOLAR_ASPECT = (135.0, 225.0)
SOLAR_MAX_SLOPE = 30.0


def _rad(degrees: Column) -> Column:
    return degrees * math.pi / 180.0


def _square(x: Column) -> Column:
    return x * x


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = _square(F.sin(_rad(lat2 - lat1) / 2.0))
    half_lon = _square(F.sin(_rad(lon2 - lon1) / 2.0))
    chord = half_lat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * half_lon
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(chord))


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return _square(lat1 - lat2) + _square(lon1 - lon2)


def _signed_delta(token: Column) -> Column:
    """One encoded number: 5-bit groups, lowest first, sign in the last bit; beyond 64 bits an error."""
    digits = F.transform(F.reverse(F.split(token, "")), lambda c: (F.ascii(c) - 63).bitwiseAND(31).cast("long"))
    raw = F.aggregate(digits, F.lit(0).cast("long"), lambda value, digit: value * 32 + digit)
    half = F.shiftright(raw, 1)
    return F.when(raw % 2 == 1, -half - 1).otherwise(half)


def polyline_vertices(df: DataFrame, keys: list[str], encoded: str) -> DataFrame:
    """Encoded polylines of at least two points to rows ``keys, idx, lat, lon, cum_m``.

    A number ends at the first character below ``_``, so one pattern cuts the string into
    numbers; latitude and longitude alternate, and running sums undo the delta coding.
    A string with a character outside the alphabet has no vertices, as its numbers can't be told apart.
    All windows run within one polyline, which is one input value, on one shuffle.
    """
    tokens = df.where(F.col(encoded).rlike(r"^[?-~]+$")).select(
        *keys,
        F.posexplode(F.regexp_extract_all(F.col(encoded), F.lit(r"([_-~]*[?-^])"), F.lit(1))).alias("n", "token"),
    )
    deltas = tokens.select(*keys, "n", _signed_delta(F.col("token")).alias("delta"))
    upto = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_lat = F.col("n") % 2 == 0
    located = (
        deltas.withColumn("lat", F.sum(F.when(is_lat, F.col("delta"))).over(upto) / POLYLINE_SCALE)
        .withColumn("lon", F.sum(F.when(~is_lat, F.col("delta"))).over(upto) / POLYLINE_SCALE)
        .withColumn("numbers", F.count("*").over(Window.partitionBy(*keys)))
        .where(~is_lat & (F.col("numbers") > 2))
        .select(*keys, F.shiftright("n", 1).alias("idx"), "lat", "lon")
    )
    return with_running_length(located, keys)


def with_running_length(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``cum_m``, the metres along the line up to each vertex."""
    order = Window.partitionBy(*keys).orderBy("idx")
    step = haversine_m(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    return (
        vertices.withColumn("step_m", F.coalesce(step, F.lit(0.0)))
        .withColumn("cum_m", F.sum("step_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("step_m")
    )


def tile_bounds(z: Column, x: Column, y: Column) -> list[Column]:
    """Web-Mercator box of a map tile: west, south, east, north in metres."""
    n = F.pow(F.lit(2.0), z)

    def meridian(col: Column) -> Column:
        return (col / n * (2.0 * math.pi) - math.pi) * MERCATOR_RADIUS_M

    def parallel(row: Column) -> Column:
        lat = F.atan(F.sinh(math.pi * (1.0 - 2.0 * row / n)))
        return F.log(F.tan(math.pi / 4.0 + lat / 2.0)) * MERCATOR_RADIUS_M

    return [
        meridian(x).alias("west"),
        parallel(y + 1).alias("south"),
        meridian(x + 1).alias("east"),
        parallel(y).alias("north"),
    ]


def slope_class(slope: Column) -> Column:
    """Classes closed below and open above."""
    label = F.lit(STEEPEST)
    for limit, name in reversed(SLOPE_LIMITS):
        label = F.when(slope < limit, name).otherwise(label)
    return F.when(slope.isNotNull(), label)


def aspect_sector(aspect: Column) -> Column:
    """Eight compass sectors centred on their direction."""
    position = F.floor(F.pmod(aspect + 22.5, F.lit(360.0)) / 45.0).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in ASPECT_SECTORS]), position + 1)


def solar_suitable(aspect: Column, slope: Column) -> Column:
    return aspect.between(*SOLAR_ASPECT) & (slope <= SOLAR_MAX_SLOPE)
