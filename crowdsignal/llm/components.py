"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(low, both.a == low.n).where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    low = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
    moved = edges.join(low, edges.b == low.n).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge, to a node that is no larger node itself: then the steps change nothing."""
    ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("larger")).union(edges.select(F.col("b").alias("n"), F.lit(1).alias("larger")))
    return ends.groupBy("n").agg(F.sum("larger").alias("k"), F.count("*").alias("all")).where("k > 1 or (k = 1 and all > 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: the smallest node that each node of an edge can reach.

    Self-loops and repeated or null edges add nothing. No edges give no rows. Each round writes its edges to the shared
    folder and drops those of the round before, so a lost executor costs one round. Neighbour lists are never collected: both steps are a minimum by key and
    a join, so that a node with millions of links is split like any skewed join key. ``max_rounds`` is a guard against a
    broken input (about the logarithm of the longest path is needed); reaching it raises an error.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = materialize(pairs, "edges")
    for _ in range(max_rounds):
        if _stars(pairs):
            break
        before, pairs = pairs, materialize(_small_star(_large_star(pairs)), "edges")
        drop(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    settled = materialize(nodes.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), "components")
    drop(pairs)
    return settled
