"""One row for each cell that a step may run: its lane, inputs and input hash.

A parent frame has lane, address, identity, output (canonical JSON) and state
(ok, failed, blocked, filtered or pending).  Candidates have lane, input_hash,
inputs (a struct with each parent's output, or null), parents (addresses),
state (the worst of the parents') and, for groups, members.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.identity import ALL, MISSING, ROOT, canonical_text, digest, set_hash, sha
from lanewright.operators.groups import grouped
from lanewright.operators.joins import lane_join, star_join
from lanewright.spec import Step

FRAME = "lane string, address string, identity string, output string, state string"


def field(path: str) -> Column:
    """A field of a JSON output as a string, or as an array of strings for a list."""
    return F.get_json_object("output", "$" + "".join(f"['{p}']" for p in path.split(".")))


def key_column(frame: DataFrame, path: str) -> Column:
    """A join or group key as an array: the elements of a list, or the one value."""
    got = field(path)
    return F.when(F.ltrim(got).startswith("["), F.from_json(got, "array<string>")).when(got.isNotNull(), F.array(got))


def worst(states: list[Column]) -> Column:
    any_ = lambda *names: reduce(lambda a, b: a | b, [s.isin(*names) for s in states])
    return F.when(any_("failed", "blocked"), "blocked").when(any_("filtered"), "filtered").when(any_("pending"), "pending").otherwise("ok")


def _hash_of(identities: Mapping[str, Column]) -> Column:
    """One parent: its identity; several: the hash of {parent: identity} by name."""
    if len(identities) == 1:
        return next(iter(identities.values()))
    parts = [F.concat(F.lit(canonical_text(n) + ':"'), identities[n], F.lit('"')) for n in sorted(identities)]
    return sha(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def root(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit(ROOT).alias("lane"), F.lit(ROOT).alias("input_hash"), F.struct(F.lit(None).cast("string").alias("_")).alias("inputs"),
        F.expr("CAST(array() AS array<string>)").alias("parents"), F.lit("ok").alias("state"),
    )


def _row(names: list[str], lane: Column, hash_: Column, state: Column) -> list[Column]:
    inputs = F.struct(*[F.col(f"{n}.output").alias(n) for n in names])
    parents = F.filter(F.array(*[F.col(f"{n}.address") for n in names]), lambda x: x.isNotNull())
    return [lane.alias("lane"), hash_.alias("input_hash"), inputs.alias("inputs"), parents.alias("parents"), state.alias("state")]


def mapped(step: Step, parents: Mapping[str, DataFrame], single: set[str], strict: bool) -> DataFrame:
    """Parents by equal lane; parents of a single lane are bound to every row."""
    names = list(dict.fromkeys(step.depends_on.values()))
    wide = [n for n in names if n not in single] or names[:1]
    joined = lane_join([(n, parents[n]) for n in wide], strict) if len(wide) > 1 else parents[wide[0]].select("lane", F.struct("*").alias(wide[0]))
    if not strict and len(wide) > 1:
        joined = joined.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in wide]))
    for n in names:
        if n not in wide:  # one row by definition, so a broadcast is bounded
            joined = joined.crossJoin(F.broadcast(parents[n].select(F.struct("*").alias(n)).limit(1)))
    return joined.select(*_row(names, F.col("lane"), _hash_of({n: F.col(f"{n}.identity") for n in names}), worst([F.col(f"{n}.state") for n in names])))


def united(step: Step, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Lanes of all parents; the hash covers every parent that has the lane."""
    names = list(step.depends_on.values())
    joined = lane_join([(n, parents[n]) for n in names], strict=False)
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"{n}.identity").alias("i")) for n in sorted(names)]), lambda x: x["i"].isNotNull())
    hash_ = F.when(F.size(pairs) == 1, pairs[0]["i"]).otherwise(sha(F.to_json(pairs)))
    first = F.coalesce(*[F.col(f"{n}.state") for n in names])
    return joined.select(*_row(names, F.col("lane"), hash_, F.when(first == "failed", "blocked").otherwise(first)))


def joined(step: Step, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Tuples of lanes with equal keys; filtered lanes and, by default, failed ones are absent."""
    sides = []
    for name, path in step.join_on.items():
        passed = parents[name].where("state = 'ok'")
        sides.append((name, passed, key_column(passed, path)))
    names = [n for n, _, _ in sides]
    rows = star_join(sides, step.join_mode)
    hash_ = _hash_of({n: F.coalesce(F.col(f"{n}.identity"), F.lit(MISSING)) for n in names})
    return rows.select(*_row(names, F.col("lane"), hash_, F.lit("ok")))


def fan_in(step: Step, parents: Mapping[str, DataFrame]) -> DataFrame:
    """(group, dep, lane, address, identity, output) of every member."""
    parts = []
    for name in dict.fromkeys(step.depends_on.values()):
        passed = parents[name].where("state = 'ok'")
        keyed = grouped(passed, key_column(passed, step.group_key) if step.group_key else None, name)
        parts.append(keyed.select("group", F.lit(name).alias("dep"), "lane", "address", "identity", "output"))
    return reduce(lambda a, b: a.union(b), parts)


def grouped_candidates(step: Step, members: DataFrame, spark: SparkSession) -> DataFrame:
    """(lane, input_hash): one row for each group, or @all even for no members."""
    hashed = members.groupBy("group").agg(set_hash(F.col("dep"), F.col("lane"), F.col("identity")).alias("h"))
    if step.group_key:
        found = hashed.select(F.col("group").alias("lane"), sha(F.concat(F.lit("group:"), F.col("group"), F.lit(":"), F.col("h"))).alias("input_hash"))
    else:
        one = spark.range(1).select(F.lit(ALL).alias("lane"))
        found = one.join(hashed, F.col("lane") == F.col("group"), "left").select("lane", F.coalesce("h", F.lit(digest("no members"))).alias("input_hash"))
    return found.withColumn("state", F.lit("ok"))
