"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; the component is its smallest node.

    Each round links every node's larger neighbours to its least neighbour (large star), then every node's smaller
    neighbours to its least one (small star), until nothing changes; the number of rounds grows with the logarithm
    of the number of nodes. Links and least neighbours are tables of ``scratch`` between steps, so a join of a node with very many
    links has two plain inputs and can be split; each round deletes those of the round before. The driver sees only sums.
    """
    edges = scratch.keep_small(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep_small(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("k"), "m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep_small(large.where("u > v").distinct())
        low = scratch.keep_small(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
        small = large.join(low, F.col("u") == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, scratch.keep_small(small.where("u > v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(old, least, large, low)
        if state == before:
            break
        before = state
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    labels = scratch.keep_small(stars.union(roots))
    scratch.drop(edges)
    return labels
