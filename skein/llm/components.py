"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) with every u's least neighbour m, itself included; partial minima shrink a hub before the shuffle."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge, from edges (a, b); the component is its least node.

    Each round is stored in the shared folder.  The rounds end when the edges are stars
    that a further round leaves as they are; they grow with the logarithm of the longest path.
    """
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        following = materialise(_small_star(_large_star(current).distinct()).distinct(), "edges")
        discard(current)
        current = following
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
