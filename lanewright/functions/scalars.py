"""Scalar helpers: durations, rates, sizes, globs and version ranges."""

from __future__ import annotations

import fnmatch
import re

from packaging.specifiers import InvalidSpecifier, SpecifierSet
from packaging.version import InvalidVersion, Version
from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_RATE_UNITS = {"s": 1, "sec": 1, "second": 1, "min": 60, "m": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}
_SIZE = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def seconds(duration: str | float | None) -> float | None:
    """Seconds of a duration such as 24h; numbers are seconds already."""
    if duration is None or isinstance(duration, (int, float)):
        return duration
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw])\s*", duration)
    if not found:
        raise ValueError(f"not a duration: {duration!r}")
    return float(found[1]) * _SECONDS[found[2]]


def per_second(rate: str | None) -> float | None:
    """Calls per second of a rate such as 10/min."""
    if rate is None:
        return None
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*/\s*([a-z]+)\s*", rate)
    if not found or found[2] not in _RATE_UNITS or not float(found[1]):
        raise ValueError(f"not a rate: {rate!r}")
    return float(found[1]) / _RATE_UNITS[found[2]]


def size_bytes(text: str) -> int:
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?B?)\s*", text.upper())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    unit = found[2] if found[2] in _SIZE else found[2] + "B"
    return int(float(found[1]) * _SIZE[unit])


def glob(column: Column, pattern: str) -> Column:
    """Shell-style match of the whole string, case-sensitive."""
    return column.rlike("^" + fnmatch.translate(pattern).replace(r"\Z", r"\z").replace(r"\z\z", r"\z"))


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[")


def versions_matching(versions: list[str], specifier: str) -> list[str]:
    """Those of a few distinct versions that a range covers; odd ones never match."""
    try:
        wanted = SpecifierSet(specifier)
    except InvalidSpecifier:
        return []
    out = []
    for v in versions:
        try:
            if wanted.contains(Version(v), prereleases=True):
                out.append(v)
        except InvalidVersion:
            continue
    return out


def field_matches(output: Column, path: str, value: str) -> Column:
    """A dotted field of a JSON output equals a string; any element of a list counts."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    got = F.get_json_object(output, "$" + steps)
    listed = F.from_json(got, "array<string>")
    test = (lambda c: glob(c, value)) if is_glob(value) else (lambda c: c == F.lit(value))
    return F.coalesce(F.when(F.ltrim(got).startswith("["), F.exists(listed, test)).otherwise(test(got)), F.lit(False))
