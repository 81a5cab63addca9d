"""Pipelines: building, planning and running a DAG of steps.

A run takes the steps in order.  For each it makes candidates from its
parents' frames, joins them with the live outputs of the step, runs the body
for what is missing, and writes all cells at once.  The written cells are the
parents' frames of the next steps, so bodies that are not deterministic run
once, and a lost executor repeats one step at most.
"""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright import spec
from lanewright.functions.identity import ALL, ROOT, address, canonical, canonical_text, digest, lane_of, set_hash, sha
from lanewright.home import Home, now_seq
from lanewright.plans import bodies, candidates
from lanewright.scope import Scope
from lanewright.spec import Step

_NULL = "CAST(NULL AS string)"


@dataclass
class Summary:
    """What a run did: counts of cell states for each step."""

    run_id: str
    status: str
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def __getattr__(self, name: str) -> int:
        if name in ("created", "reused", "failed", "blocked", "filtered"):
            return sum(c.get(name, 0) for c in self.counts.values())
        raise AttributeError(name)


class Pipeline:
    """Steps under a name; the name is part of every address."""

    def __init__(self, name: str, steps: Sequence[Step], *, retention: int | None = None, schedule: str = "broad", cache_default: bool = True, env: Sequence[str] = (), secrets: Sequence[str] = ()):
        if retention is not None and retention < 1:
            raise ValueError("retention is 1 or more")
        if schedule not in ("broad", "deep"):
            raise ValueError("schedule is broad or deep")
        declared = [*env, *secrets]
        if len(set(declared)) != len(declared) or any(not n or n.startswith("LANEWRIGHT_") for n in declared):
            raise ValueError("environment names are declared once and aren't reserved")
        self.name, self.retention, self.schedule, self.env, self.secrets = name, retention, schedule, list(env), list(secrets)
        self.cache_default = cache_default
        names = [s.name for s in steps]
        if len(set(names)) != len(names):
            raise ValueError("two steps have one name")
        for s in steps:
            if s.use_cache is None:
                s.use_cache = cache_default or s.shape in spec.FAN_IN or s.shape == "expand" or s.as_table
        self.steps = spec.order(steps)
        self.by_name = {s.name: s for s in self.steps}
        self._check()
        self.single = self._single()

    def _check(self) -> None:
        if not any(not s.depends_on for s in self.steps):
            raise ValueError("a pipeline needs a root step")
        consumers = {p for s in self.steps for p in s.depends_on.values()}
        for s in self.steps:
            if not s.depends_on and s.shape not in ("map", "expand"):
                raise ValueError(f"{s.name}: {s.shape} needs a parent")
            if not s.stored and s.name not in consumers:
                raise ValueError(f"{s.name}: a fused step needs a consumer")
            for p in s.depends_on.values():
                if not self.by_name[p].stored and (s.shape == "join" or s.group_key):
                    raise ValueError(f"{s.name}: {p} is fused, so it can't be joined or grouped")

    def _single(self) -> set[str]:
        """Steps that can only ever have one lane."""
        out: set[str] = set()
        for s in self.steps:
            parents = set(s.depends_on.values())
            alone = s.shape == "map" and parents <= out
            if alone or s.shape == "join_table" or (s.shape in ("aggregate", "fold") and not s.group_key):
                out.add(s.name)
        return out

    def closure(self, targets: Sequence[str] | None) -> list[Step]:
        """The targets and all that they depend on, in order."""
        if targets is None:
            return self.steps
        wanted = set(targets)
        for t in targets:
            if t not in self.by_name:
                raise ValueError(f"unknown target {t}")
        for s in reversed(self.steps):
            if s.name in wanted:
                wanted |= set(s.depends_on.values())
        return [s for s in self.steps if s.name in wanted]

    def descendants(self, name: str) -> set[str]:
        out = {name}
        for s in self.steps:
            if out & set(s.depends_on.values()):
                out.add(s.name)
        return out

    def definition(self) -> dict[str, Any]:
        return {"name": self.name, "retention": self.retention, "schedule": self.schedule, "env": self.env, "secrets": self.secrets, "steps": [s.snapshot() for s in self.steps]}

    def describe(self, form: str = "text") -> str:
        from lanewright.render import describe

        return describe(self, form)

    def declare(self, home: Home) -> str:
        """Records the definition without running."""
        run = uuid.uuid4().hex
        seq = now_seq()
        home.rows("runs", [(run, self.name, "declaration", "completed", None, None, canonical_text(self.definition()), None, None, seq / 1e9, seq)])
        return run

    def run(self, home: Home, params: Any = None, scope: Scope | None = None, targets: Sequence[str] | None = None) -> Summary:
        """Runs what is not live yet and returns the counts."""
        return Run(self, home, params, scope, targets).execute()

    def plan(self, home: Home, params: Any = None, scope: Scope | None = None, targets: Sequence[str] | None = None) -> DataFrame:
        """(step, lane, address, action) for every cell that is known before running: reuse, execute, pending, filtered, blocked.  Reads only."""
        return Run(self, home, params, scope, targets).plan()


def _repeats(rows: DataFrame, *by: Column | str) -> bool:
    return not rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()


class Run:
    """One pass over a pipeline's steps."""

    def __init__(self, pipeline: Pipeline, home: Home, params: Any, scope: Scope | None, targets: Sequence[str] | None):
        self.p, self.home, self.spark, self.scope = pipeline, home, home.spark, scope
        self.params = params.model_dump() if hasattr(params, "model_dump") else params
        self.steps = pipeline.closure(targets)
        if scope is not None:
            scope.check(pipeline, targets)
            if targets is None:
                inside = pipeline.descendants(scope.step)
                self.steps = [s for s in pipeline.closure(sorted(inside))]
        self.run_id, self.seq = uuid.uuid4().hex, now_seq()
        self.kind = "process" if scope is None and targets is None else "partial"
        self.frames: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}
        self.schemas = {s.name: s.schema for s in pipeline.steps}
        self.events: list[tuple] = []
        self.counts: dict[str, dict[str, int]] = {}
        self.plain: set[str] = set()  # steps whose frame is this run's cells as they were written
        self.once: set[str] = set()  # steps without an address that this run stored twice
        self.varied: set[str] = set()  # steps without an identity that two lanes have

    @cached_property
    def before(self) -> dict[str, int]:
        """How many runs before this one committed each step; a step that none did has nothing to be joined with."""
        commits = self.home.read("commits").where((F.col("pipeline") == self.p.name) & (F.col("run_id") != self.run_id))
        return {r["step"]: r["n"] for r in commits.groupBy("step").agg(F.countDistinct("run_id").alias("n")).collect()}

    def note(self, step: str, event: str, message: str, level: str = "warning", lane: str | None = None) -> None:
        self.events.append((self.run_id, self.p.name, step, lane, level, event, message, now_seq() / 1e9))

    def execute(self) -> Summary:
        with self.home.lease(self.p.name) as self.lease:
            return self._execute()

    def _execute(self) -> Summary:
        self._state("running", None, None)
        summary = Summary(self.run_id, "completed")
        try:
            for ordinal, s in enumerate(self.steps):
                if not s.stored:
                    self._fuse(s)
                    continue
                self._step(s, ordinal)
                summary.counts[s.name] = self.counts[s.name]
                if self.scope is not None and s.name == self.scope.step:
                    self._missing(s)
        except Exception as error:
            self.note("", "run_failed", str(error)[:2000], "error")
            self._state("failed", summary, str(error)[:2000])
            self.home.rows("events", self.events)
            raise
        good = summary.created + summary.reused + summary.filtered
        bad = summary.failed + summary.blocked
        summary.status = "completed" if not bad else "completed_with_failures" if good else "failed"
        self._state(summary.status, summary, None)
        self.home.rows("events", self.events)
        if self.p.retention is not None and self.kind == "process":
            from lanewright.storage import demote

            demote(self.home, self.p.name, self.p.retention)
        self.home.sweep()
        return summary

    def _state(self, status: str, summary: Summary | None, error: str | None) -> None:
        counts = canonical_text(summary.counts) if summary else None
        selection = canonical_text(self.scope.origin | {"step": self.scope.step}) if self.scope else None
        self.home.rows("runs", [(self.run_id, self.p.name, self.kind, status, canonical_text(self.params), selection, canonical_text(self.p.definition()), counts, error, now_seq() / 1e9, self.seq)])

    def _counts(self, s: Step) -> dict[str, int]:
        cells = self.home.cells(self.p.name, s.name, self.run_id).where("lane <> '@anchor' OR status IN ('failed', 'blocked')")
        return {r["status"]: r["n"] for r in cells.groupBy("status").agg(F.count("*").alias("n")).collect()}

    # candidates and decisions

    def _address(self, s: Step, hash_: Any) -> Any:
        params = digest(canonical_text(self.params)) if s.params else None
        return address(s.name, s.version, hash_, self.p.name, params, s.source_hash if s.code == "auto" else None)

    def _candidates(self, s: Step, strict: bool) -> DataFrame:
        if not s.depends_on:
            found = candidates.root(self.spark)
        elif s.shape == "join":
            found = candidates.joined(s, self.frames)
        elif s.shape == "union":
            found = candidates.united(s, self.frames)
        else:
            found = candidates.mapped(s, self.frames, self.p.single, strict)
        if self.scope is not None and s.name == self.scope.step:
            found = found.join(F.broadcast(self.scope.lanes(self.spark)), "lane", "left_semi")
        return found.withColumn("address", self._address(s, F.col("input_hash")))

    def _anchored(self, s: Step) -> DataFrame:
        """An expand step's candidates under the addresses of their anchors."""
        rows = self._candidates(s, self.scope is None)
        return rows.withColumn("address", sha(F.concat(F.lit("anchor:"), F.col("address"))))

    def _decide(self, s: Step, rows: DataFrame) -> DataFrame:
        """rows with action, and what is stored for those that are reused."""
        kinds = {"identity": "string", "output": "string", "content_type": "string", "filtered": "boolean", "reason": "string", "run_id": "string", "code_hash": "string", "ts": "double"}
        if s.name in self.before:
            kept = self.home.outputs(self.p.name, s.name, "lane = '@anchor'" if s.shape == "expand" else "true", packed=True).where("live")
            live = kept.select("key", F.col("usable").alias("was_usable"), *[F.col(n).alias(f"was_{n}") for n in kinds])
            both = rows.withColumn("key", F.unhex("address")).drop("address").join(live, "key", "left").withColumn("address", F.lower(F.hex("key"))).drop("key")
        else:
            both = rows.withColumns({"was_usable": F.lit(False)} | {f"was_{n}": F.lit(None).cast(k) for n, k in kinds.items()})
        stale = F.lit(False) if s.stale_after is None else F.col("was_ts") < now_seq() / 1e9 - s.stale_after
        reuse = F.col("was_usable") & F.lit(not s.force) & ~stale
        action = F.when(F.col("state") != "ok", F.col("state")).when(F.coalesce(reuse, F.lit(False)), "reuse").otherwise("execute")
        return both.withColumn("action", action)

    def plan(self) -> DataFrame:
        parts = []
        for s in self.steps:
            if not s.stored:
                self._fuse(s)
                continue
            if s.shape in ("aggregate", "fold", "join_table"):
                decided = self._plan_group(s)
            else:
                decided = self._decide(s, self._anchored(s) if s.shape == "expand" else self._candidates(s, self.scope is None))
            parts.append(decided.select(F.lit(s.name).alias("step"), "lane", "address", "action"))
            self.frames[s.name] = self._planned(s, decided)
        return reduce(lambda a, b: a.union(b), parts)

    def _plan_group(self, s: Step) -> DataFrame:
        waiting = reduce(lambda a, b: a.union(b), [self.frames[p].where("state = 'pending'").select("state") for p in s.depends_on.values()])
        pending = waiting.limit(1).select(F.lit(ALL).alias("lane"), F.lit("").alias("address"), F.lit("pending").alias("action"), *[F.expr(_NULL).alias(f"was_{c}") for c in ("identity", "output")])
        if not pending.isEmpty():
            return pending
        rows = candidates.grouped_candidates(s, candidates.fan_in(s, self.frames), self.spark)
        return self._decide(s, rows.withColumn("address", self._address(s, F.col("input_hash"))))

    def _planned(self, s: Step, decided: DataFrame) -> DataFrame:
        if s.shape == "expand":
            kids = self.home.outputs(self.p.name, s.name, "lane <> '@anchor'").where("live")
            if not s.depends_on and self.before.get(s.name) == 1:  # the one anchor of the one run: all that it stored are its children
                kids = kids.crossJoin(F.broadcast(decided.where("action = 'reuse'").select(F.lit(1).alias("_")).limit(1)))
            else:
                kids = kids.join(self._kin(s, decided).select("address").distinct(), "address", "left_semi")
            kids = kids.select("lane", "address", "identity", "output", F.lit("ok").alias("state"))
            rest = decided.where("action <> 'reuse'").select("lane", "address", F.expr(_NULL).alias("identity"), F.expr(_NULL).alias("output"), F.lit("pending").alias("state"))
            return kids.union(rest)
        state = F.when(F.col("action") == "reuse", "ok").when(F.col("action") == "filtered", "filtered").otherwise("pending")
        return decided.select("lane", "address", F.col("was_identity").alias("identity"), F.col("was_output").alias("output"), state.alias("state"))

    # execution

    def _fuse(self, s: Step) -> None:
        """A fused step is never stored: its address stands for its identity, its body joins its consumers' plans."""
        rows = self._candidates(s, self.scope is None)
        ran = bodies.run_column(s, rows, self.schemas, self.params) if s.body == "column" else bodies.run_python(s, rows, self.params)
        state = F.when(F.col("state") != "ok", F.col("state")).when(F.col("error").isNotNull(), "failed").when(F.col("filtered"), "filtered").otherwise("ok")
        self.frames[s.name] = ran.select("lane", "address", F.col("address").alias("identity"), "output", state.alias("state"))

    def _step(self, s: Step, ordinal: int) -> None:
        if s.as_table:
            cells = self._table_cells(s)
        elif s.shape in ("aggregate", "fold"):
            cells = self._group_cells(s)
        elif s.shape == "expand":
            cells = self._expand_cells(s)
        else:
            cells = self._row_cells(s)
        stamped = cells.select(
            "lane", "input_hash", "address", "status", "output", "content_type",
            "identity", "filtered", "reason", "error", "error_type", "attempts", F.lit(s.version).alias("version"), F.lit(s.source_hash).cast("string").alias("code_hash"), "parents", "fresh",
            F.lit(now_seq() / 1e9).alias("ts"), F.lit(self.seq + ordinal).alias("seq"),
        )
        self.home.append("cells", stamped, self._part(s))
        self.lease.renew()
        self._mark(s)
        self.home.rows("commits", [(self.run_id, self.p.name, s.name, self.seq + ordinal, s.name in self.once)])
        self.counts[s.name] = self._counts(s)
        self.frames[s.name] = self._frame(s)

    def _wide(self, s: Step) -> list[str]:
        """Parents that a map binds by lane."""
        names = list(dict.fromkeys(s.depends_on.values()))
        return [n for n in names if n not in self.p.single] or names[:1]

    def _mark(self, s: Step) -> None:
        """Whether a step's first run can hold an address or an identity twice, by its shape.

        An identity covers the payload, and with it the row key, of an expanded
        lane; an address covers its only parent's identity, or its group.
        """
        if s.name in self.before:
            return
        apart = len(self._wide(s)) == 1 and self._wide(s)[0] in self.varied
        if s.shape == "expand":
            self.varied.add(s.name)
        if not s.depends_on or s.shape in ("aggregate", "fold", "join_table") or (s.shape in ("map", "expand") and apart):
            self.once.add(s.name)

    def _frame(self, s: Step) -> DataFrame:
        """What consumers read: this run's cells, with the outputs of reused ones."""
        cells = self.home.cells(self.p.name, s.name, self.run_id).where("lane <> '@anchor'")
        state = F.when(F.col("status").isin("created", "reused"), "ok").otherwise(F.col("status"))
        new = cells.where("fresh OR status NOT IN ('reused')").select("lane", "address", "identity", "output", state.alias("state"))
        if not self.counts[s.name].get("reused"):
            self.plain.add(s.name)
            return new
        old = cells.where("NOT fresh AND status = 'reused'").select("lane", "address", "identity")
        kept = self.home.outputs(self.p.name, s.name).select("address", "output")
        return new.unionByName(old.join(kept, "address", "left").select("lane", "address", "identity", "output", F.lit("ok").alias("state")))

    def _finish(self, ran: DataFrame, s: Step) -> DataFrame:
        """Executed rows as cells: created, or reused where the stored value is the same."""
        identity = sha(F.col("output"))
        same = F.coalesce((identity == F.col("was_identity")) & ~F.lit(s.stale_after is not None), F.lit(False))
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("filtered"), "filtered").when(same, "reused").otherwise("created")
        fresh = F.col("error").isNull() & ~same
        return ran.withColumns({"identity": identity, "status": status, "fresh": fresh}).withColumn("output", F.when(F.col("fresh"), F.col("output")))

    def _settled(self, decided: DataFrame) -> DataFrame:
        """Cells that need no body: reused, filtered or blocked."""
        status = F.when(F.col("action") == "reuse", F.when(F.col("was_filtered"), "filtered").otherwise("reused")).otherwise(F.col("action"))
        null = F.expr(_NULL)
        return decided.where("action <> 'execute'").withColumns(
            {"status": status, "output": null, "content_type": F.col("was_content_type"), "identity": F.when(F.col("action") == "reuse", F.col("was_identity")), "filtered": status == "filtered",
             "reason": F.col("was_reason"), "error": null, "error_type": null, "attempts": F.lit(0), "fresh": F.lit(False)}
        )

    _CELL = ["lane", "input_hash", "address", "status", "output", "content_type", "identity", "filtered", "reason", "error", "error_type", "attempts", "parents", "fresh"]

    def _kin(self, s: Step, decided: DataFrame) -> DataFrame:
        """(anchor, up, address): the children of reused anchors, as of the run that stored the anchor."""
        kept = decided.where("action = 'reuse'").select(F.col("address").alias("parent"), F.col("was_run_id").alias("run_id"), F.col("parents").alias("up"))
        found = self.home.links("child", self.p.name, s.name).select("parent", "run_id", F.col("child").alias("address"))
        return kept.join(found, ["parent", "run_id"]).select(F.col("parent").alias("anchor"), "up", "address")

    def _link(self, s: Step, kind: str, pairs: DataFrame) -> None:
        """Appends (parent, child); they count once the step is committed."""
        self.home.append("links", pairs.withColumn("kind", F.lit(kind)), self._part(s))

    def _part(self, s: Step) -> dict[str, str]:
        """The partition of what this run writes for a step."""
        return {"pipeline": self.p.name, "step": s.name, "run_id": self.run_id}

    def _new_edges(self, s: Step, pairs: DataFrame, once: bool = False) -> None:
        """Links those (parent, child) that no earlier run has; once says that no pair comes twice."""
        pairs = pairs if once else pairs.distinct()
        if s.name in self.before:
            known = self.home.links("edge", self.p.name, s.name).select("parent", "child")
            pairs = pairs.join(known, ["parent", "child"], "left_anti")
        self._link(s, "edge", pairs)

    def _row_cells(self, s: Step) -> DataFrame:
        decided = self._decide(s, self._candidates(s, self.scope is None))
        stored = s.shape == "map" and len(self._wide(s)) == 1 and set(s.depends_on.values()) <= self.plain
        if s.name in self.before or not stored:  # else it is one pass over written cells, not worth another copy of them
            decided = self.home.cut(decided)
        self._drift(s, decided)
        if s.shape == "join":
            self._join_notes(s)
        todo = decided.where("action = 'execute'")
        if s.fn is None:  # declared union or join
            names = list(s.depends_on.values())
            if s.shape == "union":
                value = F.coalesce(*[F.col(f"inputs.{n}") for n in names])
                ran = todo.withColumns(bodies.outcome_columns(F.lit(0))).withColumn("output", value)
            else:
                nested = F.to_json(F.struct(*[F.try_parse_json(F.col(f"inputs.{n}")).alias(n) for n in names]), {"ignoreNullFields": "false"})
                ran = todo.withColumns(bodies.outcome_columns(F.lit(0))).withColumn("output", nested)
        elif s.body == "column":
            if not s.depends_on:
                made = s.fn(**({"params": self.params} if s.params else {}))
                ran = todo.withColumns(bodies.outcome_columns(made))
            else:
                ran = bodies.run_column(s, todo, self.schemas, self.params)
        else:
            ran = bodies.run_python(s, todo, self.params)
        return self._finish(ran, s).select(*self._CELL).unionByName(self._settled(decided).select(*self._CELL))

    def _missing(self, s: Step) -> None:
        from lanewright.scope import accounting

        n = accounting(self.scope, self.frames[s.name]).where("NOT reached").count()
        if n:
            self.note(s.name, "scope_lanes_missing", f"{n} lanes of the scope were not reached")

    def _join_notes(self, s: Step) -> None:
        """Warnings of a lane join: keys that repeat on several sides, failed lanes that look unmatched."""
        from lanewright.operators.joins import duplicate_keys

        sides = [(n, self.frames[n].where("state = 'ok'"), candidates.key_column(self.frames[n], path)) for n, path in s.join_on.items()]
        worst = duplicate_keys(sides).agg(F.max(F.struct("product", "_key")).alias("w")).first()["w"]
        if worst is not None:
            self.note(s.name, "duplicate_join_keys", f"key {worst['_key']} makes {worst['product']} pairs")
        for n in s.join_on:
            failed = self.frames[n].where("state IN ('failed', 'blocked')").count()
            if failed and s.join_mode == "union":
                self.note(s.name, "partial_fan_in", f"{failed} failed lanes of {n} look unmatched")

    def _drift(self, s: Step, decided: DataFrame) -> None:
        if s.code == "warn" and s.source_hash and s.name in self.before:
            other = decided.where((F.col("action") == "reuse") & (F.col("was_code_hash") != s.source_hash)).limit(1)
            if not other.isEmpty():
                self.note(s.name, "code_drift_detected", "reused outputs come from other source code")

    def _group_cells(self, s: Step) -> DataFrame:
        bad = reduce(lambda a, b: a + b, [self.frames[p].where("state IN ('failed', 'blocked')").count() for p in s.depends_on.values()])
        members = candidates.fan_in(s, self.frames)
        if not set(s.depends_on.values()) <= self.plain:
            members = self.home.cut(members)
        rows = candidates.grouped_candidates(s, members, self.spark)
        if bad:
            self.note(s.name, "partial_fan_in", f"{bad} members failed or were blocked")
            if s.on_failed == "block" or members.isEmpty():
                rows = rows.withColumn("state", F.lit("blocked"))
        rows = rows.withColumn("parents", F.expr("CAST(array() AS array<string>)"))
        decided = self.home.cut(self._decide(s, rows.withColumn("address", self._address(s, F.col("input_hash")))))
        whole = decided.where("action IN ('execute', 'reuse')").select(F.col("lane").alias("group"), F.col("address").alias("child"))
        self._new_edges(s, members.select("group", F.col("address").alias("parent")).join(whole, "group").select("parent", "child"), set(s.depends_on.values()) <= self.plain & self.once)
        todo = decided.where("action = 'execute'")
        ask = todo.select(F.col("lane").alias("group"))
        # from the members' side, so that few groups are broadcast and no group's members move before they are aggregated
        inside = members.join(ask, "group", "left_semi")
        if not s.group_key and members.isEmpty():
            inside = ask.join(members, "group", "left").withColumn("dep", F.coalesce("dep", F.lit(next(iter(s.depends_on.values())))))
        runs = {"column": bodies.run_column_group, "table": bodies.run_table_group}
        ran = runs[s.body](s, inside, self.schemas, self.params) if s.body in runs else bodies.run_group(s, inside, self.params)
        done = self._finish(todo.join(ran, "lane"), s)
        return done.select(*self._CELL).unionByName(self._settled(decided).select(*self._CELL))

    def _expand_cells(self, s: Step) -> DataFrame:
        """An anchor row for each parent, a cell for each child, and links between them."""
        decided = self._decide(s, self._anchored(s))
        again = s.name in self.before
        if again:
            live = self.home.outputs(self.p.name, s.name, "lane <> '@anchor'").where("live")
            # an anchor counts only if all of its children are still there
            kids = self._kin(s, decided).join(live.select("address"), "address", "left_anti")
            lost = kids.select(F.col("anchor").alias("address")).distinct().withColumn("lost", F.lit(True))
            decided = decided.join(lost, "address", "left").withColumn("action", F.when(F.col("lost"), "execute").otherwise(F.col("action"))).drop("lost")
        decided = self.home.cut(decided)
        self._drift(s, decided)
        todo = decided.where("action = 'execute'")
        if s.body == "column":
            if s.depends_on:
                made = s.fn(**{a: bodies.typed(F.col(f"inputs.{p}"), self.schemas.get(p)) for a, p in s.depends_on.items()})
                payload = todo.select("address", F.explode_outer(made).alias("output"))
            else:
                source = s.fn(self.spark) if inspect.signature(s.fn).parameters else s.fn()
                one = todo.select("address").limit(1)
                source = source if source.columns == ["output"] else source.select(F.struct("*").alias("output"))
                payload = one.crossJoin(source)
            payload = payload.where("output IS NOT NULL").select("address", canonical(F.col("output")).alias("payload"))
            called = todo.withColumns({"error": F.expr(_NULL), "error_type": F.expr(_NULL), "attempts": F.lit(1)})
        else:
            called = self.home.cut(bodies.run_expand(s, todo, self.params))
            payload = called.where("error IS NULL").select("address", F.explode("payloads").alias("payload"))
        # payloads move and are cut without their hashes, which are longer than most and are worked out after
        payload = payload.withColumnRenamed("address", "anchor")
        if s.row_key:
            key = F.coalesce(F.get_json_object("payload", f"$['{s.row_key}']"), F.raise_error(F.lit(f"null row key {s.row_key}")).cast("string"))
            by = ["anchor", "key"] if s.depends_on else ["key"]  # a root's one anchor needn't move with each row
            minted = self.home.cut(payload.withColumn("key", key).select(*by, "payload").repartition(*by))
            # keys that repeat are an error, so payloads needn't be grouped, which would sort them whole and spill
            if _repeats(minted, F.xxhash64(*by)) and _repeats(minted, *by):
                raise ValueError(f"{s.name}: repeated row key {s.row_key}")
            if not s.depends_on:
                minted = minted.crossJoin(F.broadcast(decided.select(F.col("address").alias("anchor")).limit(1)))
        else:
            minted = self.home.cut(payload.distinct())
        minted = minted.withColumn("h", sha(F.col("key" if s.row_key else "payload"))).withColumn("address", self._address(s, F.col("h")))
        owners = decided.select(F.col("address").alias("anchor"), F.col("parents").alias("up"))
        null = F.expr(_NULL)
        alone = F.expr("CAST(array() AS array<string>)")
        self._link(s, "child", minted.select(F.col("anchor").alias("parent"), F.col("address").alias("child")))
        every = minted.join(owners, "anchor").select("up", "address")
        if again:
            kin = self.home.cut(self._kin(s, decided))
            every = every.union(kin.select("up", "address"))
        if s.depends_on:
            self._new_edges(s, every.select(F.explode("up").alias("parent"), F.col("address").alias("child")))
            once = minted.groupBy("h").agg(F.max("payload").alias("output")).withColumn("address", self._address(s, F.col("h")))
        else:
            once = minted.select("h", F.col("payload").alias("output"), "address")
        once = once.withColumn("parents", alone)
        was = once.join(live.select("address", F.col("identity").alias("was_identity")), "address", "left") if again else once.withColumn("was_identity", null)
        made = was.withColumns(
            {"lane": lane_of(F.col("h")), "input_hash": F.col("h"), "content_type": F.lit("json"), "filtered": F.lit(False), "reason": null, "error": null, "error_type": null, "attempts": F.lit(1)}
        )
        made = self._finish(made, s)
        failed = F.col("error").isNotNull()
        anchors = called.withColumns(
            {"status": F.when(failed, "failed").otherwise("created"), "output": F.when(~failed, F.lit("[]")), "content_type": F.lit("anchor"), "identity": F.when(~failed, F.col("address")), "filtered": F.lit(False),
             "reason": null, "fresh": ~failed, "lane": F.lit("@anchor")}
        )
        idle = self._settled(decided).where("action <> 'reuse'").withColumn("lane", F.lit("@anchor"))
        parts = [made, anchors, idle]
        if again:
            known = kin.select("address").distinct().join(made.select("address"), "address", "left_anti").withColumn("parents", alone)
            kept = known.join(live.select("address", "lane", "input_hash", "identity", "content_type"), "address").withColumns(
                {"status": F.lit("reused"), "output": null, "filtered": F.lit(False), "reason": null, "error": null, "error_type": null, "attempts": F.lit(0), "fresh": F.lit(False)}
            )
            parts.append(kept)
        return reduce(lambda a, b: a.unionByName(b), [x.select(*self._CELL) for x in parts])

    # table values

    def _table_cells(self, s: Step) -> DataFrame:
        """One cell whose value is a frame, stored under its content hash."""
        parents = list(s.depends_on.values())
        rows = [self.frames[p].limit(2).collect() for p in parents]  # single-lane parents: one row each
        if any(len(r) != 1 for r in rows):
            raise ValueError(f"{s.name}: a table step's parents have one lane each")
        states = [r[0]["state"] for r in rows]
        identities = {p: r[0]["identity"] for p, r in zip(parents, rows, strict=True)}
        hash_ = ROOT if not parents else next(iter(identities.values())) if len(parents) == 1 else digest(canonical_text(identities))
        lane = ROOT if s.shape == "map" else ALL
        base = self.spark.range(1).select(F.lit(lane).alias("lane"), F.lit(hash_).alias("input_hash"), F.array(*[F.lit(r[0]["address"]) for r in rows]).cast("array<string>").alias("parents"), F.lit("ok" if all(x == "ok" for x in states) else "blocked").alias("state"))
        decided = self.home.cut(self._decide(s, base.withColumn("address", self._address(s, F.col("input_hash")))))
        row = decided.first()
        if row["action"] == "reuse":
            self.tables[s.name] = self.spark.read.parquet(json.loads(row["was_output"])["$table"])
        if row["action"] != "execute":
            return self._settled(decided).select(*self._CELL)
        outcome = bodies.attempt(s, lambda: self._table(s, row["address"]), bodies.stored)
        named = dict(zip(bodies._FIELDS, outcome, strict=True))
        ran = decided.withColumns({k: F.lit(v).cast(dict(x.split() for x in bodies.OUTCOME.split(", "))[k]) for k, v in named.items()})
        return self._finish(ran, s).select(*self._CELL)

    def _table(self, s: Step, address_: str) -> dict[str, Any]:
        given = {a: self.tables[p] if p in self.tables else bodies.loaded(self.frames[p].first()["output"]) for a, p in s.depends_on.items()}
        if s.fn is None:
            from lanewright.operators.joins import duplicate_keys, table_join

            (left, lk), (right, rk) = s.join_on.items()
            made = table_join(self.tables[left], self.tables[right], lk, rk, s.join_mode)
            twice = duplicate_keys([(n, self.tables[n].where(F.col(k).isNotNull()), F.col(k)) for n, k in s.join_on.items()]).limit(1)
            if not twice.isEmpty():
                self.note(s.name, "duplicate_join_keys", "a key repeats on both sides")
        elif s.body == "rows":
            made = bodies.run_rows(s, self.tables[next(iter(s.depends_on.values()))], self.params)
        else:
            extra = ({"spark": self.spark} if "spark" in inspect.signature(s.fn).parameters else {}) | ({"params": self.params} if s.params else {})
            made = s.fn(**given, **extra)
        if not isinstance(made, DataFrame):
            raise TypeError(f"{s.name}: an as_table step returns a frame")
        path = f"{self.home.path}/tables/{self.p.name}/{s.name}/{address_}-{self.run_id}"
        made.write.parquet(path)
        self.tables[s.name] = kept = self.spark.read.parquet(path)
        hashed = kept.agg(set_hash(canonical(F.struct(*[F.col(f"`{c}`") for c in kept.columns]))).alias("h"), F.count("*").alias("n")).first()
        return {"$table": path, "hash": hashed["h"], "rows": hashed["n"]}
