from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lanewright import Filtered, Pipeline, Scope, join, join_table, lineage, selection, step, storage, union
from lanewright import diff as differences
from lanewright.scope import accounting


def outputs(home, p, name):
    rows = home.outputs(p.name, name).where("live AND lane <> '@anchor' AND NOT filtered").select("lane", "output").collect()
    return {r["lane"]: json.loads(r["output"]) for r in rows}


def values(home, p, name):
    return sorted(map(repr, outputs(home, p, name).values()))


def orders(rows):
    def source():
        yield from rows

    source.__name__ = "orders"
    return step(source, name="orders")


ROWS = [{"id": 1, "cust": "a", "amount": 5}, {"id": 2, "cust": "b", "amount": 20}, {"id": 3, "cust": "a", "amount": 30}]


def tiers(rows=ROWS, version="1"):
    def tier(orders):
        if orders["amount"] < 0:
            return Filtered("negative")
        return {"cust": orders["cust"], "tier": "big" if orders["amount"] > 10 else "small", "amount": orders["amount"]}

    def total(tier):
        return {"n": len(tier), "sum": sum(v["amount"] for v in tier.values())}

    return Pipeline("shop", [orders(rows), step(tier, version=version), step(total, group_key="tier")])


def test_run_reuse_edit(home):
    p = tiers()
    first = p.run(home)
    assert (first.created, first.reused, first.status) == (8, 0, "completed")
    assert outputs(home, p, "total") == {"big": {"n": 2, "sum": 50}, "small": {"n": 1, "sum": 5}}
    again = p.run(home)
    assert (again.created, again.reused) == (0, 8)
    # the source is cached by its anchor; a forced one is listed again
    changed = [*ROWS[:2], {"id": 3, "cust": "a", "amount": 31}]
    p2 = tiers(changed)
    p2.by_name["orders"].force = True
    third = p2.run(home)
    assert third.counts["orders"] == {"created": 1, "reused": 2}
    assert third.counts["tier"] == {"created": 1, "reused": 2}
    assert third.counts["total"] == {"created": 1, "reused": 1}


def test_version_and_plan(home):
    p = tiers()
    plan = {(r["step"], r["action"]): r["n"] for r in p.plan(home).groupBy("step", "action").agg(F.count("*").alias("n")).collect()}
    assert plan == {("orders", "execute"): 1, ("tier", "pending"): 1, ("total", "pending"): 1}
    p.run(home)
    newer = tiers(version="2")
    plan = {(r["step"], r["action"]): r["n"] for r in newer.plan(home).groupBy("step", "action").agg(F.count("*").alias("n")).collect()}
    assert plan == {("orders", "reuse"): 1, ("tier", "execute"): 3, ("total", "pending"): 1}
    ran = newer.run(home)
    assert ran.counts["tier"] == {"created": 3}
    assert ran.counts["total"] == {"reused": 2}  # equal identities cut off what is below


def test_filter_failure_and_fan_in(home):
    rows = [{"v": 1}, {"v": -1}, {"v": 0}]

    def inverse(orders):
        if orders["v"] < 0:
            return Filtered("negative")
        return {"x": 1 / orders["v"]}

    def after(inverse):
        return inverse

    def count(inverse):
        return len(inverse)

    p = Pipeline("f", [orders(rows), step(inverse, retries=1), step(after), step(count, shape="aggregate")])
    ran = p.run(home)
    assert ran.counts["inverse"] == {"created": 1, "filtered": 1, "failed": 1}
    assert ran.counts["after"] == {"created": 1, "filtered": 1, "blocked": 1}
    assert values(home, p, "count") == ["1"] and ran.status == "completed_with_failures"
    bad = selection.failures(home, ran.run_id).collect()
    assert [(r["error_type"], r["attempts"]) for r in bad] == [("ZeroDivisionError", 2)]
    again = p.run(home)
    assert again.counts["inverse"] == {"reused": 1, "filtered": 1, "failed": 1}
    blocked = Pipeline("g", [orders(rows), step(inverse), step(count, shape="aggregate", on_failed="block")])
    assert blocked.run(home).counts["count"] == {"blocked": 1}


def test_joins(home):
    def left():
        yield from [{"oid": "o1", "cust": "c1"}, {"oid": "o2", "cust": "c1"}, {"oid": "o3", "cust": "c9"}]

    def right():
        yield from [{"cid": "c1", "name": "Alice"}, {"cid": "c2", "name": "Bob"}]

    def named(left, right):
        return [left and left["oid"], right and right["name"]]

    p = Pipeline("j", [step(left), step(right), step(named, join_on={"left": "cust", "right": "cid"}), join("both", {"left": "cust", "right": "cid"})])
    p.run(home)
    assert values(home, p, "named") == ["['o1', 'Alice']", "['o2', 'Alice']"]
    nested = outputs(home, p, "both").values()
    assert sorted(v["right"]["name"] + v["left"]["oid"] for v in nested) == ["Aliceo1", "Aliceo2"]
    outer = Pipeline("j", [step(left), step(right), step(named, join_on={"left": "cust", "right": "cid"}, join_mode="union")])
    ran = outer.run(home)
    assert ran.counts["named"] == {"reused": 2, "created": 2}  # a flip of the mode reuses matched pairs
    assert any("@missing" in lane for lane in outputs(home, outer, "named"))


def test_null_key_fails_the_run(home):
    def left():
        yield from [{"k": 1}, {"k": None}]

    def right():
        yield {"k": 1}

    def both(left, right):
        return 1

    p = Pipeline("n", [step(left), step(right), step(both, join_on={"left": "k", "right": "k"})])
    with pytest.raises(Exception, match="null join key"):
        p.run(home)
    assert [r["status"] for r in home.runs().collect()] == ["failed"]


def test_fold_union_broadcast_fused(home):
    def a():
        yield from [{"g": "e", "v": 2}, {"g": "w", "v": 3}]

    def b():
        yield from [{"g": "e", "v": 5}, {"g": "w", "v": 3}]

    def base():
        return {"plus": 10}

    def helper(lanes):
        return lanes["v"] * 2

    def doubled(helper, base):
        return helper + base["plus"]

    def add(total, value):
        return total + value["v"]

    folded = step(add, name="folded", shape="fold", fold_init=0, group_key="g", depends_on={"value": "lanes"})
    p = Pipeline("u", [step(a), step(b), step(base), union("lanes", "a", "b"), step(helper, use_cache=False), step(doubled), folded])
    p.run(home)
    assert len(outputs(home, p, "lanes")) == 3
    assert values(home, p, "doubled") == ["14", "16", "20"]
    assert outputs(home, p, "folded") == {"e": 7, "w": 3}


def test_column_bodies(home):
    def people(spark):
        return spark.createDataFrame([(1, "a", 5.0), (2, "b", 7.0), (3, "a", 1.0)], "id long, grp string, v double")

    def big(people):
        return F.struct(people.id.alias("id"), people.grp.alias("grp"), (people.v * 2).alias("w")), people.v > 2, "small"

    def total(big):
        return F.struct(F.sum(big.w).alias("w"), F.count("*").alias("n"))

    p = Pipeline("c", [
        step(people, shape="expand", body="column", row_key="id", schema="id long, grp string, v double"),
        step(big, body="column", schema="id long, grp string, w double"),
        step(total, body="column", group_key="grp"),
    ])
    ran = p.run(home)
    assert ran.counts["big"] == {"created": 2, "filtered": 1}
    assert outputs(home, p, "total") == {"a": {"n": 1, "w": 10}, "b": {"n": 1, "w": 14}}
    assert p.run(home).created == 0


def test_tables(home, spark):
    def one(spark):
        return spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")

    def two(spark):
        return spark.createDataFrame([(1, "x"), (3, "z")], "k int, r string")

    def count(joined):
        return joined.agg(F.count("*").alias("n"))

    def build(mode):
        return Pipeline("t", [step(one, as_table=True), step(two, as_table=True), join_table("joined", {"one": "k", "two": "k"}, mode), step(count, as_table=True)])

    p = build("union")
    assert p.run(home).created == 4
    run = p.run(home)
    assert run.reused == 4
    table = json.loads(home.outputs("t", "count").where("live").first()["output"])["$table"]
    assert spark.read.parquet(table).collect()[0]["n"] == 3


def test_scope_targets_diff_trace_invalidate(home):
    p = tiers()
    first = p.run(home)
    lanes = home.cells("shop", "tier", first.run_id).select("lane")
    one = lanes.orderBy("lane").limit(1).collect()[0]["lane"]
    part = tiers(version="2")
    scoped = part.run(home, scope=Scope("tier", [one, "row-nothere"], {"kind": "explicit"}), targets=["tier"])
    assert scoped.counts["tier"] == {"created": 1}
    reached = accounting(Scope("tier", [one, "row-nothere"]), home.cells("shop", "tier", scoped.run_id)).collect()
    assert sorted((r["lane"] == one, r["reached"]) for r in reached) == [(False, False), (True, True)]
    whole = part.run(home)
    assert whole.counts["tier"] == {"created": 2, "reused": 1}
    changes = differences.diff(home, "shop", "tier", first.run_id, whole.run_id)
    assert {r["change"] for r in changes.collect()} == {"unchanged"}

    found = lineage.trace(home, "step:tier cust:b").collect()
    steps = sorted({(r["relation"], r["step"]) for r in found})
    assert steps == [("downstream", "total"), ("seed", "tier"), ("upstream", "orders")]
    assert selection.select(home, "step:tier tier:big").count() == 2
    assert selection.select(home, "step:tier version:>=2").count() == 3
    lineage.invalidate(home, "step:tier cust:b", "wrong", downstream=True)
    again = part.run(home)
    assert again.counts["tier"] == {"created": 1, "reused": 2}
    assert again.counts["total"] == {"created": 1, "reused": 1}


def test_storage(home):
    for amount in (1, 2, 3):
        rows = [{"id": 1, "cust": "a", "amount": amount}]
        p = tiers(rows)
        p.by_name["orders"].force = True
        p.run(home)
    before = {(r["pipeline"], r["step"]): r for r in storage.usage(home).collect()}
    assert before[("shop", "tier")]["live_rows"] == 3
    got = storage.gc(home, retention=1)
    assert got["demoted"] == 6 and got["values"] > 0
    after = {(r["pipeline"], r["step"]): r for r in storage.usage(home).collect()}
    assert after[("shop", "tier")]["live_rows"] == 1
    assert storage.gc(home, retention=1)["values"] == 0


def test_uncommitted_cells_are_invisible(home, spark):
    p = tiers()
    ran = p.run(home)
    rows = home.read("cells").where(F.col("run_id") == ran.run_id).withColumn("run_id", F.lit("crashed"))
    home.append("cells", home.cut(rows))
    assert home.cells(run_id="crashed").count() == 0
    assert p.run(home).created == 0


def test_objects_and_lease(home, spark):
    from lanewright.home import LeaseLost

    one = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary")
    assert home.put_objects(one).count() == 2
    home.put_objects(spark.createDataFrame([(b"b",), (b"c",)], "content binary"))
    assert sorted(bytes(r["content"]) for r in spark.read.parquet(f"{home.path}/objects").collect()) == [b"a", b"b", b"c"]
    with home.lease("p"):
        with pytest.raises(LeaseLost), home.lease("p"):
            pass
        with home.lease("q"):
            pass
    with home.lease("p", ttl=-1), home.lease("p"):
        pass


def test_retry_backoff(home, tmp_path):
    """Each repeat waits longer; a call that gives up is a failed cell with its number of attempts."""
    from lanewright.plans import bodies

    waits = []

    def flaky(x):
        raise ValueError(x)

    made = step(flaky, depends_on=["x"], retries=3, retry_delay=0.5, retry_backoff=2.0)
    before, bodies.time.sleep = bodies.time.sleep, waits.append
    try:
        outcome = bodies.attempt(made, lambda: flaky(1), bodies.stored)
    finally:
        bodies.time.sleep = before
    assert waits == [0.5, 1.0, 2.0] and outcome[5:] == ("ValueError", 4)
    with pytest.raises(ValueError):
        step(flaky, depends_on=["x"], retry_backoff=0.5)


def test_row_kernel_and_table_input(home, spark):
    def base():
        return spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "k int, s string")

    def size(base):
        return F.length(base.s)

    def pair(base):
        return F.struct((base.k * 2).alias("twice"), base.s.alias("s"))

    def rows(spark):
        return spark.createDataFrame([(i, i % 2) for i in range(5)], "i long, g long")

    def wide(rows):
        return rows.agg(F.max("i").alias("most"), F.countDistinct("g").alias("n_groups"))

    def each(rows):
        return rows.groupBy("group").agg(F.sum("i").alias("s"))

    steps = [
        step(base, as_table=True), step(size, as_table=True, body="rows"), step(pair, as_table=True, body="rows"), step(rows, shape="expand", body="column", row_key="i", schema="i long, g long"),
        step(wide, shape="aggregate", body="table"), step(each, shape="aggregate", body="table", group_key="g"),
    ]
    p = Pipeline("kernels", steps)
    first = p.run(home)
    assert first.status == "completed"
    value = {r["step"] + r["lane"]: json.loads(r["output"]) for r in home.outputs("kernels").where("lane <> '@anchor' AND step <> 'rows'").collect()}
    made = {k.split("@")[0]: spark.read.parquet(v["$table"]) for k, v in value.items() if "$table" in v}
    assert sorted(map(tuple, made["size"].collect()), key=str) == [(1, "a", 1), (2, "bb", 2), (3, None, None)] and made["size"].columns == ["k", "s", "size"]
    assert sorted(map(tuple, made["pair"].collect()), key=str) == [(2, "a"), (4, "bb"), (6, None)]
    assert value["wide@all"] == {"most": 4, "n_groups": 2} and value["each0"] == {"s": 6} and value["each1"] == {"s": 4}
    assert p.run(home).created == 0
    with pytest.raises(ValueError):
        step(size, body="rows")
    with pytest.raises(ValueError):
        step(wide, body="table")


def test_page_and_existence(spark):
    from lanewright import selection
    from lanewright.operators import joins

    frame = spark.createDataFrame([(i,) for i in (5, 3, None, 1, 4)], "k int")
    rows, total = selection.page(frame, ["k"], 2, 1)
    assert [r["k"] for r in rows.collect()] == [1, 3] and total == 5
    other = spark.createDataFrame([(3,), (3,), (None,)], "k2 int")
    assert [r["k"] for r in joins.existence_join(frame, other, "k", "k2").collect()] == [3]
    assert sorted(str(r["k"]) for r in joins.existence_join(frame, other, "k", "k2", "anti").collect()) == ["1", "4", "5", "None"]
