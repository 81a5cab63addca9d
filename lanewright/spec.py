"""Steps: what a pipeline's user declares, and the rules it must meet."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from lanewright.functions import scalars

SHAPES = ("map", "expand", "aggregate", "fold", "join", "join_table", "union")
FAN_IN = ("aggregate", "fold", "join", "join_table")
NOTHING = object()


@dataclass(frozen=True)
class Filtered:
    """What a map body returns for a row that declines to go on."""

    reason: str = ""


@dataclass
class Step:
    """One declared step; calling it calls its function."""

    fn: Callable[..., Any] | None
    name: str
    shape: str
    body: str = "python"
    version: str = "1"
    depends_on: Mapping[str, str] = field(default_factory=dict)
    join_on: Mapping[str, str] | None = None
    join_mode: str = "intersect"
    group_key: str | None = None
    fold_init: Any = NOTHING
    row_key: str | None = None
    as_table: bool = False
    use_cache: bool | None = None
    force: bool = False
    stale_after: float | None = None
    on_failed: str = "use_passed"
    retries: int = 0
    retry_on: tuple[type[BaseException], ...] = (Exception,)
    retry_delay: float = 0.0
    rate: float | None = None
    code: str = "warn"
    output_model: Any = None
    assertions: tuple[Callable[[Any], Any], ...] = ()
    schema: str | None = None
    workers: int | None = None
    params: bool = False
    source_hash: str | None = None
    retry_backoff: float = 1.0

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        return self.fn(*args, **kwargs)

    @property
    def stored(self) -> bool:
        return self.use_cache is not False

    def snapshot(self) -> dict[str, Any]:
        """The definition that a run records."""
        keys = ("name", "shape", "body", "version", "join_mode", "group_key", "row_key", "as_table", "use_cache", "force", "stale_after", "on_failed", "retries", "code", "source_hash")
        out = {k: getattr(self, k) for k in keys}
        out |= {"depends_on": dict(self.depends_on), "join_on": dict(self.join_on) if self.join_on else None}
        return out | {"fold_init": None if self.fold_init is NOTHING else self.fold_init}


def infer_shape(fn: Callable[..., Any] | None, shape: str | None, join_on: Any, fold_init: Any, group_key: Any) -> str:
    """The declared shape, or what the other options and the function imply."""
    generator = fn is not None and inspect.isgeneratorfunction(fn)
    if shape is not None:
        if shape not in SHAPES:
            raise ValueError(f"unknown shape {shape!r}")
        found = shape
    elif join_on is not None:
        found = "join"
    elif fold_init is not NOTHING:
        found = "fold"
    elif group_key is not None:
        found = "aggregate"
    else:
        found = "expand" if generator else "map"
    if join_on is not None and found not in ("join", "join_table"):
        raise ValueError("join_on is for joins")
    if group_key is not None and found not in ("aggregate", "fold"):
        raise ValueError("group_key is for aggregate and fold")
    if generator and found != "expand":
        raise ValueError("a generator is an expand step")
    return found


def step(
    fn: Callable[..., Any] | None = None,
    *,
    name: str | None = None,
    shape: str | None = None,
    body: str = "python",
    version: str = "1",
    depends_on: Sequence[str] | Mapping[str, str] | None = None,
    join_on: Mapping[str, str] | None = None,
    join_mode: str = "intersect",
    group_key: str | None = None,
    fold_init: Any = NOTHING,
    row_key: str | None = None,
    as_table: bool = False,
    use_cache: bool | None = None,
    force: bool = False,
    stale_after: str | float | None = None,
    on_failed: str = "use_passed",
    retries: int = 0,
    retry_on: type[BaseException] | Sequence[type[BaseException]] = Exception,
    retry_delay: float = 0.0,
    retry_backoff: float = 1.0,
    rate_limit: str | None = None,
    code: str = "warn",
    output_model: Any = None,
    assertions: Sequence[Callable[[Any], Any]] = (),
    schema: str | None = None,
    executor: str = "spark",
    workers: int | None = None,
) -> Any:
    """Declares a step, bare or with options.

    body says what the function works on: ``column`` (columns in, a column or,
    for a source, a frame out; stays in Catalyst), ``python`` (values in and
    out, one call for each row or group), ``rows`` (a table step over one table:
    a struct of each row's columns in; a struct out makes a new table, anything
    else a column named as the step) or ``table`` (an aggregate: frames of the
    parents' lanes in, with group and lane; one row, or one for each group, out).

    The n-th repeat of a failed call waits retry_delay * retry_backoff ** (n - 1)
    seconds.
    """
    if fn is None:
        options = {k: v for k, v in locals().items() if k != "fn"}
        return lambda f: step(f, **options)
    kind = infer_shape(fn, shape, join_on, fold_init, group_key)
    parameters = list(inspect.signature(fn).parameters.values())
    loose = any(p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) for p in parameters)
    names = [p.name for p in parameters if p.name not in ("params", "spark") and p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]
    if depends_on is None:
        if loose:
            raise ValueError("a function with *args or **kwargs needs depends_on")
        parents = {n: n for n in names}
    elif isinstance(depends_on, Mapping):
        parents = dict(depends_on)
    else:
        parents = dict(zip(names if len(names) == len(depends_on) else depends_on, depends_on, strict=True))
    source = None
    try:
        source = hashlib.sha256(inspect.getsource(fn).encode()).hexdigest()
    except (OSError, TypeError):
        if code == "auto":
            raise ValueError("code='auto' needs the function's source") from None
    made = Step(
        fn, name or fn.__name__, kind, body, version, parents, join_on, join_mode, group_key, fold_init, row_key, as_table, use_cache, force,
        scalars.seconds(stale_after), on_failed, retries, tuple(retry_on) if isinstance(retry_on, Sequence) else (retry_on,), retry_delay,
        scalars.per_second(rate_limit), code, output_model, tuple(assertions), schema, workers, any(p.name == "params" for p in parameters), source, retry_backoff,
    )
    check(made, executor)
    return made


def check(s: Step, executor: str = "spark") -> None:
    """Raises ValueError for options that contradict each other."""
    rules = [
        (s.body not in ("column", "python", "rows", "table"), "body is column, python, rows or table"),
        (s.body == "rows" and not (s.as_table and s.shape == "map" and len(s.depends_on) == 1), "a body of rows is for a table step over one table"),
        (s.body == "table" and s.shape != "aggregate", "a body of table is for aggregate"),
        (s.code not in ("warn", "auto"), "code is warn or auto"),
        (s.version == "auto", "version='auto' isn't a version; use code='auto'"),
        (s.join_mode not in ("intersect", "union"), "join_mode is intersect or union"),
        (s.shape in ("join", "join_table") and not s.join_on, "a join needs join_on"),
        (s.shape in ("join", "join_table") and len(s.depends_on) < 2, "a join needs two parents"),
        (bool(s.join_on) and set(s.join_on or ()) != set(s.depends_on.values()), "join_on names the parents"),
        (s.join_mode == "union" and s.shape not in ("join", "join_table"), "join_mode is for joins"),
        (s.shape == "expand" and s.use_cache is False, "an expand step is always stored"),
        (s.shape == "expand" and len(s.depends_on) > 1, "an expand step has one parent at most"),
        (s.use_cache is False and s.shape in FAN_IN, f"{s.shape} is always stored"),
        (executor not in ("spark", "thread", "process"), "executor is spark (thread and process are accepted)"),
        (s.retries < 0, "retries can't be negative"),
        (s.retry_delay < 0 or s.retry_backoff < 1, "retry_delay is 0 or more, retry_backoff 1 or more"),
        (s.use_cache is False and (s.force or s.stale_after is not None), "force and stale_after need a stored step"),
        (s.force and s.stale_after is not None, "force and stale_after exclude each other"),
        (s.on_failed not in ("use_passed", "block"), "on_failed is use_passed or block"),
        (s.fold_init is not NOTHING and s.shape != "fold", "fold_init is for fold"),
        (s.shape == "fold" and s.fold_init is NOTHING, "a fold needs fold_init"),
        (s.shape == "fold" and len(s.depends_on) != 1, "a fold has one parent"),
        (s.as_table and s.shape == "expand", "as_table isn't for expand"),
        (s.row_key is not None and s.shape != "expand", "row_key is for expand"),
        (any(not callable(a) for a in s.assertions), "assertions are functions"),
    ]
    for broken, message in rules:
        if broken:
            raise ValueError(f"{s.name}: {message}")
    if s.shape == "fold":
        try:
            json.dumps(s.fold_init)
        except TypeError:
            raise ValueError(f"{s.name}: fold_init isn't JSON") from None


def union(name: str, *parents: str) -> Step:
    """A declared union of lanes; the first parent that has a lane wins."""
    return Step(None, name, "union", "column", depends_on={p: p for p in parents})


def join(name: str, on: Mapping[str, str], mode: str = "intersect") -> Step:
    """A declared join whose output nests the sides under their names."""
    made = Step(None, name, "join", "column", depends_on={p: p for p in on}, join_on=on, join_mode=mode)
    check(made)
    return made


def join_table(name: str, on: Mapping[str, str], mode: str = "intersect") -> Step:
    """A declared join of two table values."""
    made = Step(None, name, "join_table", "column", depends_on={p: p for p in on}, join_on=on, join_mode=mode, as_table=True)
    check(made)
    return made


def order(steps: Sequence[Step]) -> list[Step]:
    """Parents before children; unknown parents and cycles raise."""
    by_name = {s.name: s for s in steps}
    done: dict[str, int] = {}
    out: list[Step] = []
    for first in steps:
        stack = [(first.name, False)]
        while stack:
            name, after = stack.pop()
            if after:
                done[name] = 2
                out.append(by_name[name])
                continue
            if done.get(name) == 2:
                continue
            if done.get(name) == 1:
                raise ValueError(f"cycle at step {name}")
            done[name] = 1
            stack.append((name, True))
            for parent in reversed(list(by_name[name].depends_on.values())):
                if parent not in by_name:
                    raise ValueError(f"{name}: unknown parent {parent}")
                if done.get(parent) == 1:
                    raise ValueError(f"cycle at step {parent}")
                if done.get(parent) != 2:
                    stack.append((parent, False))
    return out
