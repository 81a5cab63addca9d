"""The selection language: shell-quoted key:value terms, all of which must hold."""

from __future__ import annotations

import shlex
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions import scalars
from lanewright.home import Home

RESERVED = ("source", "coord", "coordinate", "step", "pipeline", "version", "address", "live")


@dataclass
class Selection:
    """Parsed terms; an empty selection matches everything."""

    terms: dict[str, str] = field(default_factory=dict)
    fields: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Selection:
        out = cls()
        for word in shlex.split(text):
            key, colon, value = word.partition(":")
            if not colon or not key:
                raise ValueError(f"not a key:value term: {word!r}")
            if key in RESERVED:
                out.terms["coordinate" if key == "coord" else key] = value
            else:
                out.fields.append((key, value))
        if out.terms.get("live", "true") not in ("true", "false"):
            raise ValueError("live is true or false")
        return out

    def apply(self, cells: DataFrame, home: Home) -> DataFrame:
        """Cells (with output and live) that match.

        Versions are compared on the driver over the distinct ones, which are
        few; all else is pushed into the scan.
        """
        t = self.terms
        for column in ("step", "pipeline"):
            if column in t:
                cells = cells.where(scalars.glob(F.col(column), t[column]) if scalars.is_glob(t[column]) else F.col(column) == t[column])
        if "coordinate" in t:
            lane = t["coordinate"]
            short = F.col("lane").startswith(lane) if lane.startswith("row-") else F.col("lane") == lane
            cells = cells.where(scalars.glob(F.col("lane"), lane) if scalars.is_glob(lane) else short)
        if "source" in t:
            linked = home.links("edge").where(F.col("parent") == t["source"]).select(F.col("child").alias("address")).distinct().withColumn("_linked", F.lit(True))
            of_source = F.array_contains("parents", t["source"]) | (F.col("lane") == t["source"]) | F.coalesce("_linked", F.lit(False))
            cells = cells.join(linked, "address", "left").where(of_source).drop("_linked")
        if "address" in t:
            cells = cells.where(F.col("address").startswith(t["address"]))
        if "live" in t:
            cells = cells.where(F.col("live") == (t["live"] == "true"))
        if "version" in t:
            known = [r["version"] for r in cells.select("version").distinct().collect()]
            exact = t["version"] in known
            cells = cells.where(F.col("version").isin([t["version"]] if exact else scalars.versions_matching(known, t["version"])))
        for path, value in self.fields:
            cells = cells.where(scalars.field_matches(F.col("output"), path, value))
        return cells


def parsed(selection: str | Selection) -> Selection:
    return selection if isinstance(selection, Selection) else Selection.parse(selection)


def with_outputs(home: Home, cells: DataFrame) -> DataFrame:
    """Cells with the stored output of their address and whether it is live."""
    kept = home.outputs().select("address", F.col("output").alias("_output"), "live")
    return cells.drop("output").join(kept, "address", "left").withColumnRenamed("_output", "output").withColumn("live", F.coalesce("live", F.lit(False)))


def latest_runs(home: Home, kind: str = "process") -> DataFrame:
    """Each pipeline's latest run that has ended; partial runs never count."""
    from pyspark.sql import Window

    ended = home.runs().where((F.col("kind") == kind) & (F.col("status") != "running"))
    first = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("started_at"), F.desc("run_id")))
    return ended.withColumn("_n", first).where("_n = 1").drop("_n")


def current(home: Home) -> DataFrame:
    """Live cells of each pipeline's latest full run."""
    runs = latest_runs(home).select("run_id")
    cells = home.cells().where("lane <> '@anchor'").join(F.broadcast(runs), "run_id", "left_semi")
    return with_outputs(home, cells).where("live AND status IN ('created', 'reused', 'filtered')")


def select(home: Home, selection: str | Selection, run_id: str | None = None) -> DataFrame:
    """Matching cells of the current view, of one run, or of all history for live:false."""
    wanted = parsed(selection)
    if run_id is not None:
        cells = with_outputs(home, home.cells(run_id=run_id).where("lane <> '@anchor'"))
    elif wanted.terms.get("live") == "false":
        cells = home.outputs().where("lane <> '@anchor'")
    else:
        cells = current(home)
    return wanted.apply(cells, home)


def history(home: Home, selection: str | Selection) -> DataFrame:
    """Every stored output that ever matched."""
    wanted = parsed(selection)
    exact = {k: v for k, v in wanted.terms.items() if k in ("pipeline", "step") and not scalars.is_glob(v)}
    return wanted.apply(home.outputs(**exact).where("lane <> '@anchor'"), home)


def failures(home: Home, run_id: str) -> DataFrame:
    return home.cells(run_id=run_id).where("status = 'failed'").select("pipeline", "step", "lane", "error", "error_type", "attempts")


def output_for(home: Home, address: str) -> DataFrame:
    return home.outputs().where(F.col("address") == address).select("address", "lane", "output", "content_type", "live")


def recent_runs(home: Home, limit: int = 20, offset: int = 0, status: str | None = None) -> DataFrame:
    """Runs newest first; the filter comes before the limit."""
    runs = home.runs()
    runs = runs if status is None else runs.where(F.col("status") == status)
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).offset(offset).limit(limit)


def pipelines(home: Home) -> DataFrame:
    """Each pipeline with its number of runs and the latest one."""
    runs = home.runs()
    return runs.groupBy("pipeline").agg(F.count("*").alias("n_runs"), F.max_by("run_id", "started_at").alias("latest_run"), F.max_by("status", "started_at").alias("latest_status"))


def search(home: Home, run_id: str, text: str) -> DataFrame:
    """Cells of a run that contain a text (in any case) and all that is connected to them inside the run."""
    from lanewright.operators.graph import closure

    cells = with_outputs(home, home.cells(run_id=run_id).where("lane <> '@anchor'"))
    needle = F.lower(F.lit(text))
    hit = cells.where(F.contains(F.lower("lane"), needle) | F.contains(F.lower(F.coalesce("output", F.lit(""))), needle))
    here = cells.select("address").distinct()
    down = home.edges().select(F.col("parent").alias("a"), F.col("child").alias("b"))
    for end in ("a", "b"):
        down = down.join(here.withColumnRenamed("address", end), end, "left_semi")
    down = home.cut(down.select("a", "b"))
    both = down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = closure(both, hit.select(F.col("address").alias("node")), home.cut)
    return cells.join(found.withColumnRenamed("node", "address"), "address")


def page(rows: DataFrame, by: Sequence[str], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """(rows of one page in order, number of all rows)."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset are 0 or more")
    return rows.orderBy(*by).offset(offset).limit(limit), rows.count()
