"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.scratch import drop, written


def _step(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over (a, b) with b < a; sums run before any row meets another, so hubs are no group in one task."""
    if small:
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the smallest node reached."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(rounds):
        nxt = written(_step(_step(now, small=False), small=True), "cc")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop(now)
        now = nxt
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
