"""Connected components of a graph that lives in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, most: int = 50) -> DataFrame:
    """(node, root) for every node of `links` (a, b), the root being the least node of its component.

    Alternates two steps of the large-star and small-star method, each an aggregation by node for
    the least neighbour and a join that moves edges to it, until no edge changes; the number of
    rounds grows with the logarithm of the graph's size, and a hub's edges are never gathered.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, edges = edges, scratch.keep(small.distinct())
        scratch.drop(old)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("s"), F.bit_xor(F.xxhash64("b", "a")).alias("t")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
