"""N-way equijoins on string keys, inner or symmetric outer, and table joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewright.functions.identity import MISSING


class NullKeyError(ValueError):
    """A join or group key is null or missing."""


def keyed(side: DataFrame, key: Column, name: str, strict: bool = True) -> DataFrame:
    """side with its key as a string; a list key puts a row under each element.

    A null key (an empty list counts as one) fails the query that reads the
    row, as SQL's null semantics would silently drop it.
    """
    kind = side.select(key.alias("k")).schema["k"].dataType
    fail = F.raise_error(F.lit(f"null join key in {name}")).cast("string")
    if isinstance(kind, T.ArrayType):
        listed = F.array_distinct(F.transform(key, lambda x: x.cast("string")))
        bad = key.isNull() | (F.size(key) == 0) | F.exists(listed, lambda x: x.isNull())
        safe = F.when(bad, F.array(fail)).otherwise(listed) if strict else F.when(~bad, listed)
        return side.withColumn("_key", F.explode(safe))
    text = key.cast("string")
    return side.withColumn("_key", F.coalesce(text, fail) if strict else text)


def star_join(sides: Sequence[tuple[str, DataFrame, Column]], mode: str = "intersect") -> DataFrame:
    """Joins (name, frame with a column lane, key) sides on equal keys.

    The result has ``lane`` (the members' lanes joined by a bar, @missing for
    an absent side) and a nullable struct column for each side's row.  mode is
    ``intersect`` (every side present) or ``union`` (any).  Pairs that a list
    key would give twice come once.
    """
    if mode not in ("intersect", "union"):
        raise ValueError(f"join mode {mode!r}")
    listed = False
    parts = []
    for name, frame, key in sides:
        listed |= isinstance(frame.select(key.alias("k")).schema["k"].dataType, T.ArrayType)
        packed = keyed(frame, key, name)
        parts.append(packed.select("_key", F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias(name)))
    joined = reduce(lambda a, b: a.join(b, "_key", "inner" if mode == "intersect" else "full_outer"), parts)
    names = [name for name, _, _ in sides]
    lane = F.concat_ws("|", *[F.coalesce(F.col(f"{n}.lane").cast("string"), F.lit(MISSING)) for n in names])
    out = joined.select(lane.alias("lane"), *names)
    return out.dropDuplicates(["lane"]) if listed else out


def duplicate_keys(sides: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(_key, n_<side>..., product) for keys that more than one side repeats."""
    counts = [keyed(f, k, n).groupBy("_key").agg(F.count("*").alias(f"n_{n}")) for n, f, k in sides]
    joined = reduce(lambda a, b: a.join(b, "_key"), counts)
    product = reduce(lambda a, b: a * b, [F.col(f"n_{n}") for n, _, _ in sides])
    repeated = reduce(lambda a, b: a + b, [(F.col(f"n_{n}") > 1).cast("int") for n, _, _ in sides])
    return joined.withColumn("product", product).where(repeated > 1)


def table_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, mode: str = "intersect") -> DataFrame:
    """Two tables on one key: inner, or full outer with the keys coalesced under the left name."""
    for frame, key, side in ((left, left_key, "left"), (right, right_key, "right")):
        if key not in frame.columns:
            raise ValueError(f"no column {key} on the {side}")

    def strict(frame: DataFrame, key: str, side: str) -> Column:
        fail = F.raise_error(F.lit(f"null join key on the {side}")).cast(frame.schema[key].dataType)
        return F.coalesce(F.col(key), fail)

    a = left.withColumn(left_key, strict(left, left_key, "left")).alias("a")
    b = right.withColumn(right_key, strict(right, right_key, "right")).alias("b")
    ka, kb = F.col(f"a.{left_key}"), F.col(f"b.{right_key}")
    joined = a.join(b, ka == kb, "inner" if mode == "intersect" else "full_outer")
    rest = [F.col(f"a.{c}") for c in left.columns if c != left_key]
    rest += [F.col(f"b.{c}").alias(c if c not in left.columns else f"{c}_right") for c in right.columns if c != right_key]
    return joined.select(F.coalesce(ka, kb).alias(left_key), *rest)


def lane_join(sides: Sequence[tuple[str, DataFrame]], strict: bool = True) -> DataFrame:
    """Rows of several frames that share a lane; a lane that a side lacks is an error."""
    parts = [f.select("lane", F.struct(*[F.col(f"`{c}`") for c in f.columns]).alias(n)) for n, f in sides]
    joined = reduce(lambda a, b: a.join(b, "lane", "full_outer"), parts)
    if strict:
        absent = reduce(lambda a, b: a | b, [F.col(n).isNull() for n, _ in sides])
        joined = joined.withColumn("lane", F.when(absent, F.raise_error(F.concat(F.lit("disjoint lane sets at "), F.col("lane"))).cast("string")).otherwise(F.col("lane")))
    return joined


def existence_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, mode: str = "semi") -> DataFrame:
    """Rows of left whose key right has (semi) or lacks (anti); a null key is in neither side."""
    if mode not in ("semi", "anti"):
        raise ValueError("mode is semi or anti")
    keys = right.select(F.col(right_key).alias("_key")).where("_key IS NOT NULL").distinct()
    return left.join(keys, F.col(left_key) == F.col("_key"), f"left_{mode}")
