"""Connected components of an edge table by alternating star contractions, without collecting any of it."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of the edges (a, b: long); component is the smallest node reachable.

    Each round hangs the larger neighbours of every node to its smallest one (large star), then the smaller ones
    (small star), until nothing moves. A node with very many neighbours is a skewed join key, which adaptive
    execution splits; its minimum is aggregated before the shuffle. Rounds are written to the shared folder.
    """
    edges = materialize(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # large star: each neighbour v > u of u is hung to the least of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        # small star: u and its smaller neighbours are hung to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = materialize(small.filter("a <> b").distinct(), "small-star")
        # done if the edges are stars: no node is both a leaf and a centre
        stars = small.select("b").distinct().join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and small.groupBy("a").count().filter("count > 1").isEmpty()
        edges = small
        if stars:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
