"""A home: the append-only tables that remember what ran and what it made.

Every step of a run writes its cells once; a commit row makes them visible.
Cells that stored something new carry the output, so outputs and liveness are
views of the cells, plus a log of later liveness changes.  A cell names its own
parents where a step binds them by lane, which are as many as the step has;
members of groups and children of expanded lanes, which may be any number, are
rows of their own in the table of links.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.session import ship

CELLS = (
    "run_id string, pipeline string, step string, lane string, input_hash string, address string, status string, output string, "
    "content_type string, identity string, filtered boolean, reason string, error string, error_type string, attempts int, "
    "version string, code_hash string, parents array<string>, fresh boolean, ts double, seq bigint"
)
TABLES = {
    "cells": CELLS,
    # kind edge: child was made from parent; kind child: an anchor (parent) has this child since that run
    "links": "run_id string, pipeline string, step string, kind string, parent string, child string",
    # once: the run stored no address of the step twice
    "commits": "run_id string, pipeline string, step string, seq bigint, once boolean",
    "runs": "run_id string, pipeline string, kind string, status string, params string, selection string, definition string, summary string, error string, ts double, seq bigint",
    "events": "run_id string, pipeline string, step string, lane string, level string, event string, message string, ts double",
    # a row without pipeline and step counts for all of them
    "liveness": "address string, fulfilled boolean, run_id string, reason string, seq bigint, pipeline string, step string",
    "reclamations": "address string, identity string, bytes bigint, trigger string, run_id string, ts double",
}
PARTITIONS = {"cells": ["pipeline", "step", "run_id"], "links": ["pipeline", "step", "run_id"]}
#: Hashes in hex are most of what a home holds; Parquet's usual codec leaves them as they are, this one halves them.
CODEC = "zstd"


class Home:
    """All tables below one path of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        if not isinstance(path, str):
            raise TypeError("a home's path is a string")
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, name: str) -> bool:
        files, at = self._hadoop(f"{self.path}/{name}")
        return files.exists(at)

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            return self._empty(TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _empty(self, schema: str) -> DataFrame:
        """No rows, and the optimizer sees it: a join with them moves nothing."""
        columns = [c.split() for c in schema.split(", ")]
        return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(t).alias(n) for n, t in columns])

    def append(self, name: str, frame: DataFrame, part: dict[str, str] | None = None) -> None:
        """Appends a frame's rows.

        part holds the partition that all of them belong to, if it is one; they go straight to
        its folder, as a dynamic write would first sort whole rows by it, and spill.
        """
        path = f"{self.path}/{name}"
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        if part:
            folder = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
            path = "/".join([path, *[folder(c, part[c]) for c in PARTITIONS[name]]])
            columns = [c for c in columns if c not in part]
        writer = frame.select(*columns).write.mode("append").option("compression", CODEC)
        (writer.partitionBy(*PARTITIONS[name]) if name in PARTITIONS and not part else writer).parquet(path)

    def rows(self, name: str, rows: Sequence[tuple]) -> None:
        """Appends a few rows that the driver made."""
        if rows:
            self.append(name, self.spark.createDataFrame(list(rows), TABLES[name]).coalesce(1))

    def cut(self, frame: DataFrame) -> DataFrame:
        """Writes a frame to a scratch folder of the home and reads it back."""
        path = f"{self.path}/_scratch/{uuid.uuid4().hex}"
        frame.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def sweep(self) -> None:
        """Deletes scratch folders; no frame made with them may be used after."""
        files, at = self._hadoop(f"{self.path}/_scratch")
        files.delete(at, True)

    def put_objects(self, values: DataFrame) -> DataFrame:
        """Stores values (content, as binary) that are not there yet under their hash; returns (hash, bytes) of all.

        Equal content is stored once, whoever writes it.
        """
        hashed = self.cut(values.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"]))
        path = f"{self.path}/objects"
        new = hashed
        if self.exists("objects"):
            new = hashed.join(self.spark.read.parquet(path).select("hash"), "hash", "left_anti")
        new.write.mode("append").parquet(path)
        return hashed.select("hash", F.octet_length("content").cast("long").alias("bytes"))

    def objects(self) -> DataFrame:
        if not self.exists("objects"):
            return self.spark.createDataFrame([], "hash string, content binary")
        return self.spark.read.parquet(f"{self.path}/objects").dropDuplicates(["hash"])

    @contextmanager
    def lease(self, pipeline: str, ttl: float = 180.0) -> Iterator[Lease]:
        """One writer for each pipeline: a file that only one can create, and that runs out."""
        held = Lease(self, f"{self.path}/_leases/{pipeline}", ttl)
        held.take()
        try:
            yield held
        finally:
            held.give_back()

    def cells(self, pipeline: str | None = None, step: str | None = None, run_id: str | None = None) -> DataFrame:
        """Committed cells; the arguments prune partitions."""
        return self._committed("cells", pipeline, step, run_id, self.read("commits"))

    def links(self, kind: str, pipeline: str | None = None, step: str | None = None) -> DataFrame:
        """Committed links of one kind; the arguments prune partitions."""
        return self._committed("links", pipeline, step, None, self.read("commits")).where(F.col("kind") == kind)

    def _committed(self, table: str, pipeline: str | None, step: str | None, run_id: str | None, commits: DataFrame) -> DataFrame:
        found = _of(self.read(table), pipeline, step)
        if run_id is not None:
            found = found.where(F.col("run_id") == run_id)
        done = commits.select("run_id", "pipeline", "step").distinct()
        return found.join(F.broadcast(done) if run_id else done, ["run_id", "pipeline", "step"], "left_semi")

    def outputs(self, pipeline: str | None = None, step: str | None = None, part: str = "true", packed: bool = False) -> DataFrame:
        """The newest stored row of each address, with live: whether it may be reused.

        part is a condition on lanes.  packed is for joins that decide: addresses
        are 32 bytes in a column key, and usable says whether a row holds a value
        or a verdict, so that the value itself needn't move.  Rows are only moved where they must be: no row
        is older than another while steps ran once, and nothing is dead before
        the log names one of these steps.
        """
        commits = self.read("commits")
        stored = self._committed("cells", pipeline, step, None, commits).where("fresh").where(part)
        by = "key" if packed else "address"
        if packed:
            stored = stored.withColumns({"key": F.unhex("address"), "usable": F.col("identity").isNotNull() | F.col("filtered")}).drop("address")
        several = _of(commits, pipeline, step).groupBy("pipeline", "step").agg(F.countDistinct("run_id").alias("n"), F.min(F.coalesce("once", F.lit(False))).alias("once"))
        if not several.where("n > 1 OR NOT once").limit(1).isEmpty():
            newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))
            stored = stored.withColumn("_n", newest).where("_n = 1").drop("_n")
        log = _of(self.read("liveness"), pipeline, step, unnamed=True)
        if log.limit(1).isEmpty():
            return stored.withColumn("live", F.lit(True))
        # an address is dead if its last word in the log, against what was stored since, is not live
        last = log.groupBy((F.unhex("address") if packed else F.col("address")).alias(by)).agg(F.max_by("fulfilled", "seq").alias("f"), F.max("seq").alias("off_seq"))
        dead = last.where("NOT f").select(by, "off_seq")
        return stored.join(dead, by, "left").withColumn("live", F.col("off_seq").isNull() | (F.col("off_seq") < F.col("seq"))).drop("off_seq")

    def edges(self) -> DataFrame:
        """(parent, child) addresses, once each."""
        bound = self.cells().where("status IN ('created', 'reused', 'filtered')").select(F.explode("parents").alias("parent"), F.col("address").alias("child"))
        return bound.union(self.links("edge").select("parent", "child")).distinct()

    def runs(self) -> DataFrame:
        """The last state of each run, newest first, with its start."""
        each = self.read("runs").groupBy("run_id").agg(F.max_by(F.struct("*"), F.struct("seq", F.col("status") != "running", "ts")).alias("r"), F.min("ts").alias("started_at"))
        return each.select("r.*", "started_at").orderBy(F.desc("started_at"), F.desc("run_id"))

    def events(self, run_id: str | None = None) -> DataFrame:
        found = self.read("events")
        return found if run_id is None else found.where(F.col("run_id") == run_id)


def _of(frame: DataFrame, pipeline: str | None, step: str | None, unnamed: bool = False) -> DataFrame:
    """A table's rows of a pipeline and a step; of those without a name too, if asked."""
    for column, value in (("pipeline", pipeline), ("step", step)):
        if value is not None:
            same = F.col(column) == value
            frame = frame.where(same | F.col(column).isNull() if unnamed else same)
    return frame


class LeaseLost(RuntimeError):
    """Another writer has the pipeline."""


class Lease:
    """A lock file with its owner and the time that it runs out."""

    def __init__(self, home: Home, path: str, ttl: float):
        self.home, self.path, self.ttl, self.owner = home, path, ttl, uuid.uuid4().hex

    def _read(self) -> dict | None:
        rows = self.home.spark.read.text(self.path).collect()
        return json.loads(rows[0]["value"]) if rows else None

    def _write(self, overwrite: bool) -> None:
        files, at = self.home._hadoop(self.path)
        out = files.create(at, overwrite)
        out.write(bytearray(json.dumps({"owner": self.owner, "until": time.time() + self.ttl}).encode()))
        out.close()
        self.written = time.time()

    def take(self) -> None:
        files, at = self.home._hadoop(self.path)
        if files.exists(at):
            now = self._read()
            if now is not None and now["until"] > time.time():
                raise LeaseLost(f"another run holds {self.path}")
            files.delete(at, False)
        self._write(False)  # fails if another writer was faster

    def renew(self) -> None:
        """Before each commit: fails if the lease ran out and another took it."""
        if time.time() - self.written < self.ttl / 3:
            return
        now = self._read()
        if now is None or now["owner"] != self.owner:
            raise LeaseLost(f"the lease on {self.path} was lost")
        self._write(True)

    def give_back(self) -> None:
        files, at = self.home._hadoop(self.path)
        if files.exists(at) and (self._read() or {}).get("owner") == self.owner:
            files.delete(at, False)


def now_seq() -> int:
    return time.time_ns() // 1000 * 1000
