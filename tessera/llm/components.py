"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps replace edges, never add a pair for every two neighbours; minima are pre-aggregated, and a hub's edges are split
over tasks where they meet its minimum (``split_join``). Each round is a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT, checkpointed, split_join


def _large_star(edges: DataFrame, total: int, hot: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = split_join(both.where("v > u"), least, ["u"], ["v"], hot=hot, total=2 * total)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int, hot: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = split_join(down, least, ["u"], ["v"], hot=hot, total=total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: longs) that isn't a root; root is the component's least node."""
    state = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    edges = checkpointed(edges.where("u <> v").select("u", "v"))
    before = state(edges)
    while before["n"]:
        # A large star of n edges has at most n, a small star at most 2 n.
        edges = checkpointed(_small_star(checkpointed(_large_star(edges, before["n"], hot)), before["n"], hot))
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
