"""Reachability over an edge table, one frontier join for each level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, seeds: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, depth): every node that seeds (node) reach along edges (a to b), with the least depth.

    cut writes a frame and reads it back, so that each level starts from files.
    """
    steps = cut(edges.select("a", "b").distinct())
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    levels, depth = [frontier], 0
    while True:
        depth += 1
        new = frontier.join(steps, frontier["node"] == steps["a"]).select(F.col("b").alias("node")).distinct()
        for level in levels:
            new = new.join(level, "node", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 8:  # keep the plan short: one table for all nodes so far
            levels = [cut(_all(levels))]
    return _all(levels)


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out
