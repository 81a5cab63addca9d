"""Command line: look at a home, trace, invalidate and reclaim."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from lanewright import lineage, selection, storage
from lanewright.envcheck import undeclared
from lanewright.functions.identity import short_lane
from lanewright.functions.scalars import size_bytes
from lanewright.home import Home
from lanewright.session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lanewright")
    top.add_argument("--home", default=".lanewright")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, what in (("ls", "cells of the current view"), ("show", "outputs"), ("trace", "lineage"), ("invalidate", "mark as not live")):
        sub = verbs.add_parser(verb, help=what)
        sub.add_argument("selection", nargs="?" if verb == "ls" else None, default="")
        if verb == "invalidate":
            sub.add_argument("--downstream", action="store_true")
            sub.add_argument("--reason", default="")
    verbs.add_parser("runs", help="runs, newest first").add_argument("--limit", type=int, default=20)
    verbs.add_parser("du", help="storage by step")
    gc = verbs.add_parser("gc", help="reclaim storage")
    gc.add_argument("--keep", type=int)
    gc.add_argument("--budget", type=size_bytes)
    gc.add_argument("--dry-run", action="store_true")
    check = verbs.add_parser("check", help="environment reads that a pipeline doesn't declare")
    check.add_argument("pipeline", help="module:attribute")
    return top


def main(arguments: Sequence[str] | None = None, spark=None) -> int:
    a = parser().parse_args(arguments)
    if a.verb == "check":
        module, _, name = a.pipeline.partition(":")
        p = getattr(importlib.import_module(module), name)
        found = undeclared([s.fn for s in p.steps if s.fn], [*p.env, *p.secrets])
        print("\n".join(sorted(found)) or "all declared")
        return int(bool(found))
    home = Home(spark or local_session(), a.home)
    if a.verb in ("ls", "show"):
        for r in selection.select(home, a.selection).orderBy("pipeline", "step", "lane").toLocalIterator():
            tail = f"  {r['output']}" if a.verb == "show" else ""
            print(f"{r['pipeline']}/{r['step']}  {short_lane(r['lane'])}  {r['status'] if 'status' in r else ''}  {r['address'][:12]}{tail}")
    elif a.verb == "trace":
        for r in lineage.trace(home, a.selection).orderBy("relation", "depth", "step", "lane").toLocalIterator():
            print(f"{r['relation']:>10} {r['depth']}  {r['step']}  {short_lane(r['lane'])}  {r['output']}{'' if r['live'] else '  (not live)'}")
    elif a.verb == "invalidate":
        print(lineage.invalidate(home, a.selection, a.reason, a.downstream))
    elif a.verb == "runs":
        for r in selection.recent_runs(home, a.limit).collect():
            print(f"{r['run_id'][:12]}  {r['pipeline']}  {r['kind']}  {r['status']}  {r['summary'] or ''}")
    elif a.verb == "du":
        for r in storage.usage(home).orderBy(*[c for c in ("pipeline", "step")]).collect():
            print(f"{r['pipeline'] or 'total'}/{r['step'] or '*'}  {r['n_rows']} rows  {r['live_rows']} live  {r['bytes']} bytes  {r['reclaimable']} reclaimable")
    elif a.verb == "gc":
        print(storage.gc(home, a.keep, a.budget, a.dry_run))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
