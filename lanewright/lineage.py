"""Lineage: tracing outputs up and down, and invalidating them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions.identity import canonical_text
from lanewright.home import Home, now_seq
from lanewright.operators.graph import closure
from lanewright.selection import Selection, history, parsed


def trace(home: Home, selection: str | Selection) -> DataFrame:
    """(address, relation, depth, pipeline, step, lane, output, live) around the live matches.

    relation is seed, upstream or downstream; a node that is both is upstream,
    and depth is the least number of edges.
    """
    seeds = home.cut(history(home, selection).where("live").select(F.col("address").alias("node")))
    edges = home.cut(home.edges())
    up = closure(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")), seeds, home.cut)
    down = closure(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")), seeds, home.cut)
    named = [up.withColumn("rank", F.when(F.col("depth") == 0, 0).otherwise(1)), down.where("depth > 0").withColumn("rank", F.lit(2))]
    nodes = reduce(lambda a, b: a.union(b), named).groupBy("node").agg(F.min(F.struct("rank", "depth")).alias("x"))
    relation = F.element_at(F.array(F.lit("seed"), F.lit("upstream"), F.lit("downstream")), F.col("x.rank") + 1)
    nodes = nodes.select(F.col("node").alias("address"), relation.alias("relation"), F.col("x.depth").alias("depth"))
    kept = home.outputs().where("lane <> '@anchor'").select("address", "pipeline", "step", "lane", "output", "live")
    return nodes.join(kept, "address")


def trace_edges(home: Home, nodes: DataFrame) -> DataFrame:
    """The edges between traced nodes."""
    ends = nodes.select("address")
    edges = home.edges()
    return edges.join(ends.withColumnRenamed("address", "parent"), "parent", "left_semi").join(ends.withColumnRenamed("address", "child"), "child", "left_semi")


def invalidate(home: Home, selection: str | Selection, reason: str = "", downstream: bool = False) -> str:
    """Marks live matches, and if asked all that was made from them, as not live; returns the run's id.

    One append, so it happens as a whole or not at all.
    """
    run, seq = uuid.uuid4().hex, now_seq()
    wanted = parsed(selection)
    gone = history(home, wanted).where("live").select("address", "pipeline", "step")  # one live row for each address
    if downstream:
        edges = home.edges().select(F.col("parent").alias("a"), F.col("child").alias("b"))
        hit = closure(home.cut(edges), home.cut(gone.select(F.col("address").alias("node"))), home.cut).select(F.col("node").alias("address"))
        gone = home.outputs().where("live").select("address", "pipeline", "step").join(hit, "address", "left_semi")
    home.append("liveness", gone.select("address", F.lit(False).alias("fulfilled"), F.lit(run).alias("run_id"), F.lit(reason).alias("reason"), F.lit(seq).alias("seq"), "pipeline", "step"))
    n = home.read("liveness").where(F.col("run_id") == run).count()
    summary = canonical_text({"invalidated": n, "reason": reason, "downstream": downstream})
    text = canonical_text({"terms": wanted.terms, "fields": wanted.fields})
    home.rows("runs", [(run, None, "invalidate", "completed", None, text, None, summary, None, seq / 1e9, seq)])
    return run
