"""Connected components of a graph by alternating star steps (Kiveris et al. 2014), a DataFrame plan each.

A step takes the least neighbour of every node by a pre-aggregated shuffle and ties its
neighbours to it. Rounds grow with the logarithm of the component size; there are as
many as it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import staged


def _step(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step; edges (u, v) point from the greater to the lesser node."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    large = staged(large)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return staged(tied.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge (u, v) to another; the label is the least node of its component."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    while True:
        # Done when a step changes nothing: every node then points at the root of its component.
        digest = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first())
        if digest == before or digest[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before, now = digest, _step(now)
