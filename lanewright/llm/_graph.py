"""Connected components as joins and grouped minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm._state import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is its component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    step hangs a node's neighbours below its smallest one, until all hang below
    their root.  Grouped minima are combined before they are shuffled, and the
    joins are on written tables, so a hub's edges can be split over tasks.
    Each step is cut, so a lost executor costs one step at most.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        # large star: larger neighbours of a node hang below its smallest neighbour (or itself)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = scratch.cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        scratch.drop(least, now)
        # small star: a node and its smaller neighbours hang below the smallest of them
        least = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        up = large.join(least, "a")
        now = scratch.cut(up.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        scratch.drop(large, least)
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == found:
            break
        mark = found
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return scratch.cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))


def local_roots(near: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    root = np.arange(len(near))
    while True:
        next_root = np.minimum(root, np.where(near, root[None, :], len(near)).min(axis=1, initial=len(near)))
        next_root = next_root[next_root]
        if (next_root == root).all():
            return root
        root = next_root
