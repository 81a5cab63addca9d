"""A pipeline's steps as text, a tree of characters or a mermaid graph."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from lanewright.pipeline import Pipeline


def describe(pipeline: Pipeline, form: str = "text") -> str:
    if form not in ("text", "ascii", "mermaid"):
        raise ValueError("form is text, ascii or mermaid")
    return {"text": _text, "ascii": _ascii, "mermaid": _mermaid}[form](pipeline)


def _note(step) -> str:
    marks = [step.shape, f"v{step.version}"]
    marks += [m for m, on in (("fused", not step.stored), ("table", step.as_table), (f"by {step.group_key}", step.group_key), ("force", step.force)) if on]
    return ", ".join(marks)


def _text(pipeline: Pipeline) -> str:
    lines = [f"pipeline {pipeline.name}"]
    for s in pipeline.steps:
        source = " <- " + ", ".join(s.depends_on.values()) if s.depends_on else ""
        lines.append(f"  {s.name} ({_note(s)}){source}")
    return "\n".join(lines)


def _ascii(pipeline: Pipeline) -> str:
    lines, shown = [pipeline.name], set()

    def walk(name: str, indent: str) -> None:
        kids = [s.name for s in pipeline.steps if name in s.depends_on.values()]
        for i, kid in enumerate(kids):
            last = i + 1 == len(kids)
            again = kid in shown
            lines.append(f"{indent}{'`-' if last else '|-'} {kid}{' ^' if again else f' [{pipeline.by_name[kid].shape}]'}")
            if not again:
                shown.add(kid)
                walk(kid, indent + ("   " if last else "|  "))

    for s in pipeline.steps:
        if not s.depends_on:
            lines.append(f"* {s.name} [{s.shape}]")
            walk(s.name, "  ")
    return "\n".join(lines)


def _mermaid(pipeline: Pipeline) -> str:
    lines = ["graph TD"]
    lines += [f'  {s.name}["{s.name}<br/>{_note(s)}"]' for s in pipeline.steps]
    lines += [f"  {p} --> {s.name}" for s in pipeline.steps for p in s.depends_on.values()]
    return "\n".join(lines)


def run_view(definition: dict, counts: dict[str, dict[str, int]]) -> list[dict]:
    """A run's steps in sections: a section starts at a root, a branch, a join or a fan-in."""
    steps = {s["name"]: s for s in definition["steps"]}
    children: dict[str, list[str]] = {n: [] for n in steps}
    for name, s in steps.items():
        for parent in s["depends_on"].values():
            children[parent].append(name)
    sections: list[dict] = []
    of: dict[str, dict] = {}
    for name, s in steps.items():
        parents = list(s["depends_on"].values())
        kind = "root" if not parents else "join" if len(parents) > 1 else "fold" if s["shape"] in ("aggregate", "fold") else "branch" if len(children[parents[0]]) > 1 else None
        if kind is None and parents[0] in of:
            section = of[parents[0]]
        else:
            section = {"kind": kind or "branch", "from": parents, "steps": []}
            sections.append(section)
        of[name] = section
        section["steps"].append({"name": name, "shape": s["shape"], "counts": counts.get(name, {})})
    return sections
