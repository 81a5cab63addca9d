"""Storage: what a home holds, retention, and reclaiming what nothing needs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.identity import canonical_text
from lanewright.home import Home, now_seq


def usage(home: Home) -> DataFrame:
    """Rows, live rows, distinct values and bytes for each step, each pipeline and in all.

    A value counts once in each scope, as equal values share an identity.
    """
    rows = home.outputs().where("lane <> '@anchor'").select("pipeline", "step", "identity", "live", F.coalesce(F.octet_length("output"), F.lit(0)).cast("long").alias("bytes"))
    none = F.lit(None).cast("string")
    pair = lambda p, s: F.struct(p.alias("p"), s.alias("s"))
    scopes = F.array(pair(F.col("pipeline"), F.col("step")), pair(F.col("pipeline"), none), pair(none, none))
    scoped = rows.select("*", F.explode(scopes).alias("scope"))
    value = scoped.groupBy("scope", "identity").agg(F.count("*").alias("n"), F.sum(F.col("live").cast("long")).alias("n_live"), F.max("bytes").alias("bytes"))
    return value.groupBy(F.col("scope.p").alias("pipeline"), F.col("scope.s").alias("step")).agg(
        F.sum("n").alias("n_rows"), F.sum("n_live").alias("live_rows"), F.count("identity").alias("n_values"), F.sum("bytes").alias("bytes"),
        F.sum(F.when(F.col("n_live") == 0, F.col("bytes")).otherwise(0)).alias("reclaimable"),
    )


def last_runs(home: Home, pipeline: str, keep: int) -> DataFrame:
    """The last so many ended full runs."""
    ended = home.runs().where((F.col("pipeline") == pipeline) & (F.col("kind") == "process") & (F.col("status") != "running"))
    place = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("started_at"), F.desc("run_id")))
    return ended.withColumn("_n", place).where(F.col("_n") <= max(keep, 1)).select("run_id")


def demote(home: Home, pipeline: str, keep: int, run_id: str | None = None) -> int:
    """Outputs that none of the last runs used are no longer live; anchors stay."""
    used = home.cells(pipeline).join(F.broadcast(last_runs(home, pipeline, keep)), "run_id", "left_semi").select("address").distinct()
    old = home.cut(home.outputs(pipeline).where("live AND lane <> '@anchor'").join(used, "address", "left_anti").select("address", "pipeline", "step"))
    found = old.count()
    if found:
        home.append("liveness", old.select("address", F.lit(False).alias("fulfilled"), F.lit(run_id or "").alias("run_id"), F.lit("retention").alias("reason"), F.lit(now_seq()).alias("seq"), "pipeline", "step"))
    return found


def over_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Of live rows (address, bytes, seq) the oldest that must go for the rest to fit."""
    days = rows.withColumn("slot", F.col("seq"))
    by_slot = days.groupBy("slot").agg(F.sum("bytes").alias("b"))  # one row for each run's step
    newer = F.sum("b").over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0))
    gone = by_slot.withColumn("kept", newer).where(F.col("kept") > budget).select("slot")
    return rows.join(F.broadcast(gone), rows["seq"] == gone["slot"], "left_semi").select("address")


def gc(home: Home, retention: int | None = None, budget: int | None = None, dry_run: bool = False) -> dict[str, int]:
    """Demotes by retention or by a budget of bytes, then records and reclaims what has no live reference."""
    running = home.runs().where("status = 'running'").limit(1)
    if not running.isEmpty():
        raise RuntimeError("a run is not over")
    run, seq, demoted = uuid.uuid4().hex, now_seq(), 0
    names = [r["pipeline"] for r in home.runs().where("pipeline IS NOT NULL").select("pipeline").distinct().collect()]
    if not dry_run:
        for name in names if retention is not None else []:
            demoted += demote(home, name, retention, run)
        if budget is not None:
            latest = home.cells().join(F.broadcast(_latest(home, names)), "run_id", "left_semi").select("address").distinct()
            live = home.outputs().where("live AND lane <> '@anchor'").join(latest, "address", "left_anti")
            held = home.outputs().where("live").agg(F.coalesce(F.sum(F.octet_length("output")), F.lit(0))).first()[0]
            free = live.agg(F.coalesce(F.sum(F.octet_length("output")), F.lit(0))).first()[0]
            old = home.cut(over_budget(live.select("address", F.octet_length("output").cast("long").alias("bytes"), "seq"), max(0, budget - (held - free))))
            demoted += old.count()
            home.append("liveness", old.select("address", F.lit(False).alias("fulfilled"), F.lit(run).alias("run_id"), F.lit("budget").alias("reason"), F.lit(seq).alias("seq"), F.lit(None).cast("string").alias("pipeline"), F.lit(None).cast("string").alias("step")))
    done = home.read("reclamations").select("identity").distinct()
    kept = home.outputs().where("live").select("identity").distinct()
    dead = home.outputs().where("NOT live AND lane <> '@anchor'").join(kept, "identity", "left_anti").join(done, "identity", "left_anti")
    values = home.cut(dead.groupBy("identity").agg(F.first("address").alias("address"), F.max(F.coalesce(F.octet_length("output"), F.lit(0))).cast("long").alias("bytes"), F.max("output").alias("output")))
    total = values.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    if not dry_run:
        home.append("reclamations", values.select("address", "identity", "bytes", F.lit("gc").alias("trigger"), F.lit(run).alias("run_id"), F.lit(seq / 1e9).alias("ts")))
        for row in values.where(F.col("output").startswith('{"$table"') | F.contains("output", F.lit('"$table"'))).select("output").toLocalIterator():
            files, at = home._hadoop(json.loads(row["output"])["$table"])
            files.delete(at, True)
        home.rows("runs", [(run, None, "gc", "completed", None, None, None, canonical_text({"demoted": demoted, "values": total["n"], "bytes": total["b"]}), None, seq / 1e9, seq)])
    return {"demoted": demoted, "values": total["n"], "bytes": total["b"]}


def _latest(home: Home, names: list[str]) -> DataFrame:
    found = [last_runs(home, n, 1) for n in names]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def compact(home: Home, pipeline: str, step: str) -> DataFrame:
    """The newest live row of each lane: what a rewritten step table would hold."""
    newest = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("seq")))
    return home.outputs(pipeline, step).where("live").withColumn("_n", newest).where("_n = 1").drop("_n")
