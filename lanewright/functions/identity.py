"""Content identities as column expressions.

A value's identity is the SHA-256 of its canonical JSON (sorted keys, no
spaces, nulls kept); an address is the SHA-256 of what produced a value.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that stand for the absence of a real lane.
ROOT, ALL, MISSING = "@root", "@all", "@missing"


def sha(column: Column | str) -> Column:
    return F.sha2(column if isinstance(column, Column) else F.col(column), 256)


def canonical(column: Column) -> Column:
    """Canonical JSON of any value; the variant type sorts keys at every depth."""
    packed = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    whole = F.to_json(F.parse_json(packed), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def canonical_text(value: Any) -> str:
    """Canonical JSON of a Python value, for bodies in Python."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=_plain)


def _plain(value: Any) -> Any:
    for name in ("model_dump", "to_dict", "asDict", "item"):
        if hasattr(value, name):
            return getattr(value, name)()
    raise TypeError(f"a step can't store a {type(value).__name__}")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lane_of(payload_hash: Column) -> Column:
    """The lane of an expanded row: the whole hash, so lanes never collide at scale."""
    return F.concat(F.lit("row-"), payload_hash)


def short_lane(lane: str) -> str:
    """For display: twelve hex digits."""
    return lane[:16] if lane.startswith("row-") else lane


def address(step: str, version: str, input_hash: Column, pipeline: str, params: str | None = None, code: str | None = None) -> Column:
    tail = (f":params:{params}" if params else "") + (f":code:{code}" if code else "") + f":pipeline:{pipeline}"
    return sha(F.concat(F.lit(f"{step}:{version}:"), input_hash, F.lit(tail)))


def set_hash(*parts: Column) -> Column:
    """An aggregate: the hash of a set of rows, whatever their order.

    Sums of four pieces of each row's SHA-256, so it is combined before the
    shuffle and never gathers a group's members in one place.
    """
    row = sha(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]))
    sums = [F.sum(F.conv(F.substring(row, 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return sha(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(s, F.lit("0")) for s in sums]))
