"""Running step functions: as columns, or in Python with errors kept by row.

A failing row never fails the job: its error is an outcome like any other.
"""

from __future__ import annotations

import base64
import inspect
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewright.functions.identity import ALL, canonical, canonical_text
from lanewright.spec import NOTHING, Filtered, Step

OUTCOME = "output string, content_type string, filtered boolean, reason string, error string, error_type string, attempts int"
_FIELDS = [x.split()[0] for x in OUTCOME.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32()]


def stored(value: Any) -> tuple[str, str]:
    """(text, content type) of a value; raises TypeError for what can't be stored."""
    if isinstance(value, (bytes, bytearray)):
        return canonical_text(base64.b64encode(bytes(value)).decode()), "bytes"
    return canonical_text(value), "text" if isinstance(value, str) else "json"


def loaded(text: str | None, content_type: str | None = None) -> Any:
    if text is None:
        return None
    value = json.loads(text)
    return base64.b64decode(value) if content_type == "bytes" else value


def _checked(step: Step, value: Any) -> Any:
    if isinstance(value, Filtered):
        return value
    if step.output_model is not None:
        model = step.output_model
        value = model.model_validate(value) if hasattr(model, "model_validate") else model(value)
    for test in step.assertions:
        if test(value) is False:
            raise AssertionError(f"{step.name}: {getattr(test, '__name__', 'assertion')} failed")
    return value


def attempt(step: Step, call: Callable[[], Any], keep: Callable[[Any], Any]) -> tuple[Any, ...]:
    """The outcome of a call with its retries: (kept, type, filtered, reason, error, error type, attempts)."""
    tries = 0
    while True:
        tries += 1
        try:
            value = call()
            if isinstance(value, Filtered):
                return None, None, True, value.reason, None, None, tries
            text, kind = keep(value)
            return text, kind, False, None, None, None, tries
        except Exception as error:
            if tries <= step.retries and isinstance(error, step.retry_on):
                time.sleep(step.retry_delay * step.retry_backoff ** (tries - 1))
                continue
            return None, None, False, None, str(error), type(error).__name__, tries


def _arguments(step: Step, row: dict[str, Any], params: Any) -> dict[str, Any]:
    found = {arg: loaded(row[parent]) for arg, parent in step.depends_on.items()}
    return found | ({"params": params} if step.params else {})


def run_python(step: Step, rows: DataFrame, params: Any) -> DataFrame:
    """rows with the outcome of calling the step's function on each row's inputs."""
    pace = 1 / step.rate if step.rate else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for batch in batches:
            out = []
            for row in batch.column("inputs").to_pylist():
                if pace:
                    time.sleep(max(0.0, last + pace - time.monotonic()))
                    last = time.monotonic()
                out.append(attempt(step, lambda row=row: _checked(step, step.fn(**_arguments(step, row, params))), stored))
            columns = list(zip(*out, strict=True)) or [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=[*batch.schema.names, *_FIELDS])

    dealt = rows.repartition(1) if pace else rows.repartition(step.workers) if step.workers else rows
    return dealt.mapInArrow(work, _schema(rows) + ", " + OUTCOME)


def run_expand(step: Step, rows: DataFrame, params: Any) -> DataFrame:
    """rows with payloads (array of JSON) and the outcome of the call as a whole."""

    def payloads(value: Any) -> tuple[list[str], str]:
        if isinstance(value, (dict, str, bytes)) or value is None:
            raise TypeError("an expand step yields or returns several payloads")
        return [stored(_checked(step, v))[0] for v in value], "json"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [attempt(step, lambda row=row: step.fn(**_arguments(step, row, params)), payloads) for row in batch.column("inputs").to_pylist()]
            columns = list(zip(*out, strict=True)) or [[]] * len(_FIELDS)
            types = [pa.list_(pa.string()), *_TYPES[1:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*batch.schema.names, "payloads", *_FIELDS[1:]])

    return rows.mapInArrow(work, _schema(rows) + ", " + OUTCOME.replace("output string", "payloads array<string>"))


def run_group(step: Step, members: DataFrame, params: Any) -> DataFrame:
    """(lane, outcome) for each group of members (group, dep, lane, output); a fold goes in lane order.

    A Python function needs its group's values in one process; column bodies
    have no such bound.
    """
    deps = {arg: parent for arg, parent in step.depends_on.items()}

    def work(key: tuple, table: pa.Table) -> pa.Table:
        values: dict[str, dict[str, Any]] = {p: {} for p in deps.values()}
        for dep, lane, output in sorted(zip(*(table.column(c).to_pylist() for c in ("dep", "lane", "output")), strict=True), key=lambda r: r[:2]):
            if lane is not None:
                values[dep][lane] = loaded(output)
        extra = {"params": params} if step.params else {}

        def call() -> Any:
            if step.fold_init is NOTHING:
                return _checked(step, step.fn(**{arg: values[p] for arg, p in deps.items()}, **extra))
            total = json.loads(json.dumps(step.fold_init))
            names = list(inspect.signature(step.fn).parameters)
            for value in next(iter(values.values())).values():
                total = step.fn(total, value, **extra) if len(names) > 1 else step.fn(total)
            return _checked(step, total)

        outcome = attempt(step, call, stored)
        return pa.table({"lane": pa.array([key[0].as_py()], pa.string()), **{n: pa.array([v], t) for n, v, t in zip(_FIELDS, outcome, _TYPES, strict=True)}})

    return members.select("group", "dep", "lane", "output").groupBy("group").applyInArrow(work, "lane string, " + OUTCOME)


def _schema(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def typed(output: Column, schema: str | None) -> Column:
    """A parent's output as its step declared it, else as a variant."""
    return F.from_json(output, schema) if schema else F.try_parse_json(output)


def outcome_columns(result: Any) -> dict[str, Column]:
    """The outcome of a column body: a column, or (column, keep condition, reason)."""
    value, keep, reason = result if isinstance(result, tuple) else (result, F.lit(True), "")
    kept = F.coalesce(keep, F.lit(False))
    none = F.lit(None).cast("string")
    return {
        "output": F.when(kept, canonical(value)), "content_type": F.when(kept, F.lit("json")), "filtered": ~kept,
        "reason": F.when(~kept, F.lit(reason)), "error": none, "error_type": none, "attempts": F.lit(1),
    }


def run_column(step: Step, rows: DataFrame, schemas: dict[str, str | None], params: Any) -> DataFrame:
    """rows with the outcome of a column body, all inside Catalyst."""
    arguments = {arg: typed(F.col(f"inputs.{parent}"), schemas.get(parent)) for arg, parent in step.depends_on.items()}
    if step.params:
        arguments["params"] = params
    return rows.withColumns(outcome_columns(step.fn(**arguments)))


def run_column_group(step: Step, members: DataFrame, schemas: dict[str, str | None], params: Any) -> DataFrame:
    """(lane, outcome): the step's function returns an aggregate, or merges (accumulator, value) for a fold."""
    (_, parent), schema = next(iter(step.depends_on.items())), None
    schema = schemas.get(parent)
    if step.fold_init is not NOTHING:
        items = members.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("lane", "output"))).alias("items"))
        init = F.lit(step.fold_init).cast(step.schema) if step.schema else F.lit(step.fold_init)
        value = F.aggregate("items", init, lambda acc, x: step.fn(acc, typed(x["output"], schema)))
        return items.select(F.col("group").alias("lane"), value.alias("v")).select("lane", *[c.alias(n) for n, c in outcome_columns(F.col("v")).items()])
    extra = {"params": params} if step.params else {}
    result = step.fn(typed(F.col("output"), schema), **extra)
    made = members.groupBy("group").agg(result.alias("v"))
    return made.select(F.col("group").alias("lane"), *[c.alias(n) for n, c in outcome_columns(F.col("v")).items()])


def run_table_group(step: Step, members: DataFrame, schemas: dict[str, str | None], params: Any) -> DataFrame:
    """(lane, outcome): the step's function gets each parent's lanes as a frame and returns one row, or one for each group."""
    there = members.where("lane IS NOT NULL")
    frames = {a: there.where(F.col("dep") == p).select("group", "lane", typed(F.col("output"), schemas.get(p)).alias("v")) for a, p in step.depends_on.items()}
    frames = {a: f.select("group", "lane", "v.*") if schemas.get(step.depends_on[a]) else f for a, f in frames.items()}
    made = step.fn(**frames, **({"params": params} if step.params else {}))
    if "group" not in made.columns:
        made = made.withColumn("group", F.lit(ALL))
    value = F.struct(*[F.col(f"`{c}`") for c in made.columns if c != "group"])
    return made.select(F.col("group").alias("lane"), *[c.alias(n) for n, c in outcome_columns(value).items()])


def run_rows(step: Step, table: DataFrame, params: Any) -> DataFrame:
    """A table with the step's column, or the table of the structs that the step makes of each row."""
    argument = next(iter(step.depends_on))
    value = step.fn(**{argument: F.struct(*[F.col(f"`{c}`") for c in table.columns])}, **({"params": params} if step.params else {}))
    made = table.select(value.alias(step.name))
    return made.select(f"`{step.name}`.*") if isinstance(made.schema[0].dataType, StructType) else table.withColumn(step.name, value)
