"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import shared_table


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has long columns ``src`` and ``dst`` (any direction, repeats and
    loops allowed, nulls ignored). Returns ``node``, ``component`` with the
    smallest node of the component. An empty table gives an empty result.

    Alternating large-star and small-star steps: every step replaces the edges
    of a node by edges to its smallest neighbour, with a grouped minimum
    (combined before the shuffle) and a join back, so a node of any degree is
    never gathered in one task. Each round is written to the shared folder.
    """
    e = (edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
         .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    e = shared_table(e, "edges")
    before = None
    for _ in range(max_rounds):
        e = shared_table(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """For every node, its larger neighbours point to the smallest of all."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """For every node, its smaller neighbours and itself point to the smallest."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = (e.join(least, "hi").filter("lo <> m")
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
