"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is a pre-aggregated minimum per node and a join, so a hub's edges are never
gathered; every step is written to the shared folder. Rounds grow with the logarithm
of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Workspace

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour (or itself); edges point down."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(down: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them."""
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent and every parent is a root, so that parents are labels."""
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every node with an edge (u, v); the label is the component's least node."""
    now = work.stage(edges.select("u", "v").where("u != v"), f"{name}-0")
    if not now.isEmpty():
        for r in range(1, MAX_ROUNDS + 1):
            large = work.stage(_large(now), f"{name}-{r}large")
            now = work.stage(_small(large), f"{name}-{r}")
            work.drop(f"{name}-{r}large")
            work.drop(f"{name}-{r - 1}")
            if _settled(now):
                break
        else:
            raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def spread(edges: DataFrame, hops: int = 3) -> DataFrame:
    """(node, label): the least node within some hops. Equal labels mean connected; the reverse need not hold."""
    both = _both(edges)
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    for _ in range(hops - 1):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        labels = labels.join(near.select(F.col("u").alias("node"), "m"), "node").select("node", F.least("label", "m").alias("label"))
    return labels
