"""Differences between two runs of one step."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.home import Home


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(lane, change, old_output, new_output) of two frames (lane, status, identity, output)."""
    a = old.select("lane", *[F.col(c).alias(f"old_{c}") for c in ("status", "identity", "output")])
    b = new.select("lane", *[F.col(c).alias(f"new_{c}") for c in ("status", "identity", "output")])
    failed = F.col("new_status").isin("failed", "blocked")
    change = (
        F.when(F.coalesce(failed, F.lit(False)), "failed")
        .when(F.col("old_identity").isNull() & F.col("new_identity").isNotNull(), "added")
        .when(F.col("new_identity").isNull(), "removed")
        .when(F.col("old_identity") == F.col("new_identity"), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, "lane", "full_outer").select("lane", change.alias("change"), "old_output", "new_output")


def diff(home: Home, pipeline: str, step: str, old_run: str, new_run: str, lanes: DataFrame | None = None) -> DataFrame:
    """Changes by lane; the lanes are those given, else a partial run's own, else all of both runs."""
    sides = []
    for run in (old_run, new_run):
        cells = home.cells(pipeline, step, run).where("lane <> '@anchor'")
        kept = home.outputs(pipeline, step).select("address", F.col("output").alias("kept"))
        stored = cells.join(kept, "address", "left").select("lane", "status", "identity", F.coalesce("output", "kept").alias("output"))
        sides.append(stored)
    if lanes is None:
        kinds = {r["run_id"]: r["kind"] for r in home.runs().where(F.col("run_id").isin(old_run, new_run)).collect()}
        if kinds.get(new_run) == "partial":
            lanes = sides[1].select("lane")
    if lanes is not None:
        sides = [s.join(lanes.select("lane").distinct(), "lane", "left_semi") for s in sides]
    return classify(*sides)


def value_diff(old: Any, new: Any, path: str = "") -> list[dict[str, str]]:
    """Nested changes with dotted paths; a null counts as absent, texts get a line diff."""
    if old == new:
        return []
    if isinstance(old, dict) and isinstance(new, dict):
        out = []
        for key in sorted({*old, *new}):
            out += value_diff(old.get(key), new.get(key), f"{path}.{key}" if path else key)
        return out
    kind = "added" if old is None else "removed" if new is None else "changed"
    entry = {"path": path, "kind": kind, "old": json.dumps(old, ensure_ascii=False), "new": json.dumps(new, ensure_ascii=False)}
    if isinstance(old, str) and isinstance(new, str) and ("\n" in old or "\n" in new):
        entry["text"] = "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm=""))
    return [entry]


def details(changes: DataFrame) -> DataFrame:
    """changes with an array of field changes, worked out for changed rows only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("path", "kind", "old", "new", "text")]))
        for batch in batches:
            rows = []
            for change, old, new in zip(*(batch.column(c).to_pylist() for c in ("change", "old_output", "new_output")), strict=True):
                load = lambda x: None if x is None else json.loads(x)
                rows.append([{"text": None} | d for d in value_diff(load(old), load(new))] if change == "changed" else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "fields"])

    schema = "lane string, change string, old_output string, new_output string, fields array<struct<path:string,kind:string,old:string,new:string,text:string>>"
    return changes.mapInArrow(work, schema)
