"""Grouping by string or list keys, folds in lane order, and unions of lanes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.identity import ALL
from lanewright.operators.joins import keyed


def grouped(frame: DataFrame, key: Column | None, name: str = "input") -> DataFrame:
    """frame with a column group: the key as a string, each element of a list key, or @all."""
    if key is None:
        return frame.withColumn("group", F.lit(ALL))
    return keyed(frame, key, name).withColumnRenamed("_key", "group")


def aggregate(frame: DataFrame, key: Column | None, aggs: Sequence[Column], name: str = "input") -> DataFrame:
    """One row for each group; without a key one row even for no input."""
    if key is None:
        return frame.agg(*aggs).select(F.lit(ALL).alias("group"), "*")
    return grouped(frame, key, name).groupBy("group").agg(*aggs)


def cogrouped(sides: Sequence[tuple[str, DataFrame, Column, Sequence[Column]]]) -> DataFrame:
    """Aggregates of several inputs side by side, for groups that any of them has."""
    parts = [aggregate(f, k, aggs, n) for n, f, k, aggs in sides]
    return reduce(lambda a, b: a.join(b, "group", "full_outer"), parts)


def fold(frame: DataFrame, key: Column | None, init: Column, merge: Callable[[Column, Column], Column], value: Column, lane: str = "lane") -> DataFrame:
    """Folds each group's values in order of their lane: (group, value).

    The order is part of the meaning, so a group's values come together in one
    row; use ``aggregate`` where the merge is commutative.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(lane).alias("lane"), value.alias("v"))))
    rows = aggregate(frame, key, [items.alias("items")])
    return rows.select("group", F.aggregate("items", init, lambda acc, x: merge(acc, x["v"])).alias("value"))


def union_lanes(frames: Sequence[DataFrame], lane: str = "lane") -> DataFrame:
    """All lanes of all frames; of a lane that several have, the first frame's row stays."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    first = F.row_number().over(Window.partitionBy(lane).orderBy("_rank"))
    return both.withColumn("_first", first).where("_first = 1").drop("_rank", "_first")


def latest(frame: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by an order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
