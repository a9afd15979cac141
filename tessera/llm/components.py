"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b), both long; root is the smallest node of its component.

    A node's neighbours are never gathered: its smallest neighbour is aggregated and joined back, so a hub is a hot
    key of a join of two written tables only. The rounds grow with the logarithm of the longest chain.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # Large star: every larger neighbour goes to the smallest one.
        large = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        discard(least)
        # Small star: every smaller neighbour, and the node itself, go to the smallest one.
        small = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        step = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        nxt = materialise(step.where("a <> b").distinct())
        discard(large, small, now)
        now, before, state = nxt, state, _state(nxt)
        if state == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def labels(edges: DataFrame, steps: int = 3) -> DataFrame:
    """Rows (node, label) of every node of written edges (a, b): equal labels say that nodes are connected.

    The least label of the neighbours, so many times: cheaper than components(), and not always complete.
    """
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    for _ in range(steps - 1):
        now = materialise(now)
        told = both.join(now.withColumnRenamed("a", "b"), "b").select("a", "label").unionByName(now)
        now = told.groupBy("a").agg(F.min("label").alias("label"))
    return now.withColumnRenamed("a", "node")
