"""Measures of places: amenity diversity, relief and map tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.functions import geo

# Fixed values
AMENITIES = ("food", "health", "parks", "retail", "culture")


def diversity_index(amenities: DataFrame) -> DataFrame:
    """Shannon index over the five amenity categories of each site.

    ``-sum(p ln p)`` written as ``ln N - sum(c ln c) / N``, so that counts need no second pass.
    """
    counts = (
        amenities.where(F.col("category").isin(*AMENITIES))
        .groupBy("site_id", "category").agg(F.count("*").alias("c"))
    )
    n = F.sum("c")
    return counts.groupBy("site_id").agg(
        n.alias("amenities"),
        F.count("*").alias("categories"),
        (F.log(n) - F.sum(F.col("c") * F.log("c")) / n).alias("shannon"),
    )


def relief_summary(cells: DataFrame) -> DataFrame:
    """Height range and mean and the solar-suitable share of each area."""
    return cells.groupBy("area_id").agg(
        F.count("*").alias("cells"),
        F.min("height").alias("height_min"),
        F.max("height").alias("height_max"),
        F.avg("height").alias("height_mean"),
        F.avg(F.coalesce(geo.solar_suitable(F.col("aspect"), F.col("slope")), F.lit(False)).cast("int")).alias("solar_share"),
    )


def relief_classes(cells: DataFrame) -> DataFrame:
    """Cells of each area by slope class and aspect sector."""
    return cells.groupBy(
        "area_id",
        geo.slope_class(F.col("slope")).alias("slope_class"),
        geo.aspect_sector(F.col("aspect")).alias("aspect_sector"),
    ).agg(F.count("*").alias("cells"))


def tile_boxes(tiles: DataFrame) -> DataFrame:
    """``z, x, y`` with the tile's Web-Mercator box."""
    return tiles.select("z", "x", "y", *geo.tile_bounds(F.col("z"), F.col("x"), F.col("y")))
