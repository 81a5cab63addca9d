"""What queries shuffle, spill and write for each row, as Spark counts it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewright import Pipeline, catalogue, step

N = 10_000


def stages(spark):
    context = spark.sparkContext
    gateway = context._gateway
    store = context._jsc.sc().statusStore()
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def moved(spark, work) -> int:
    """Bytes shuffled, spilled and written by the stages that work starts."""
    last = max((s.stageId() for s in stages(spark)), default=-1)
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in stages(spark) if s.stageId() > last)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("moved"))
    keys = spark.range(1, N + 1, numPartitions=2)
    price = (F.xxhash64("id") % 20_000_000).cast("double") / 100 + 200_000
    keys.select(F.col("id").alias("o_orderkey"), price.alias("o_totalprice"), F.concat(F.lit("P"), F.col("id") % 5).alias("o_orderpriority")).write.parquet(f"{path}/orders.parquet")
    return path


def check(spark, orders, name):
    """At most 1,000 bytes a row; it took 1,800 to 3,600 when first runs joined, sorted and copied what nothing had stored."""
    rows = []
    bytes_ = moved(spark, lambda: rows.extend(catalogue.QUERIES[name](spark, orders).collect()))
    assert bytes_ < 1_000 * N, f"{bytes_ / N:.0f} bytes a row"
    return rows, [r["o_totalprice"] for r in spark.read.parquet(f"{orders}/orders.parquet").collect()]


def test_reuse_plan_moves_little(spark, orders):
    rows, prices = check(spark, orders, "reuse_plan")
    large = sum(p >= 250_000 for p in prices)
    assert {(r["step"], r["action"]): r["n"] for r in rows} == {("orders", "reuse"): 1, ("tier", "execute"): large, ("tier", "reuse"): N - large, ("total", "pending"): 1}


def test_map_broadcast_moves_little(spark, orders):
    rows, prices = check(spark, orders, "map_broadcast")
    mean = sum(round(p * 100) for p in prices) / N
    assert len({r["o_orderkey"] for r in rows}) == N and sum(r["above"] for r in rows) == sum(round(p * 100) > mean for p in prices)


def test_map_classify_rollup_moves_little(spark, orders):
    rows, prices = check(spark, orders, "map_classify_rollup")
    assert sum(r["n_orders"] for r in rows) == N and sum(r["cents"] for r in rows) == sum(round(p * 100) for p in prices)


def test_filter_fan_in_moves_little(spark, orders):
    rows, prices = check(spark, orders, "filter_fan_in")
    assert len(rows) == 5 and sum(r["n"] for r in rows) == sum(p >= 50_000 for p in prices)


def test_filter_verdict_moves_little(spark, orders):
    rows, prices = check(spark, orders, "filter_verdict")
    assert len({r["o_orderkey"] for r in rows}) == N and sum(r["filtered"] for r in rows) == sum(p < 50_000 for p in prices)


def test_writes_sort_nothing_by_their_partition(spark, home):
    """A run's cells and links of a step are one partition: sorting whole rows by it would only spill."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()

    def rows(spark):
        return spark.range(4).select("id")

    def twice(rows):
        return F.struct((rows.id * 2).alias("v"))

    name = "one/part=a b"
    p = Pipeline(name, [step(rows, shape="expand", body="column", row_key="id", schema="id long"), step(twice, body="column", schema="v long")])
    p.run(home)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList(int(first), 1000)
    plans = [found.apply(i).physicalPlanDescription() for i in range(found.size())]
    writes = [text for text in plans if "InsertIntoHadoopFsRelationCommand" in text]
    assert writes and not [text for text in writes if "[pipeline#" in text and "Sort" in text]
    assert home.cells(name, "twice").count() == 4 and home.links("child", name, "rows").count() == 4
    assert p.run(home).reused == 8


def test_expand_sorts_no_payloads(spark, home):
    """Keys alone are looked through for repeats: to group whole payloads by them would sort, and spill, what the table holds."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()

    def rows(spark):
        return spark.range(4).select("id")

    def kids(rows):
        return F.array(F.struct((rows.id * 2).alias("k")), F.struct((rows.id * 2 + 1).alias("k")))

    p = Pipeline("sorts", [step(rows, shape="expand", body="column", row_key="id", schema="id long"), step(kids, shape="expand", body="column", row_key="k", schema="k long")])
    assert p.run(home).created == 4 + 8
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList(int(first), 1000)
    plans = [found.apply(i).physicalPlanDescription() for i in range(found.size())]
    assert [text for text in plans if "get_json_object(payload" in text]
    assert not [text for text in plans if "get_json_object(payload" in text and "Sort" in text]
    held = home.links("child", "sorts")
    assert held.where("step = 'rows'").select("parent").distinct().count() == 1 and held.where("step = 'kids'").select("parent").distinct().count() == 4
    assert p.run(home).reused == 4 + 8


def test_one_key_of_two_anchors_is_no_repeat(home):
    def rows(spark):
        return spark.range(2).select("id")

    def kids(rows):
        return F.array(F.struct(F.lit(1).alias("k")), F.struct(F.lit(2).alias("k")))

    def twins(rows):
        return F.array(F.struct(F.lit(1).alias("k")), F.struct(F.lit(1).alias("k")))

    start = step(rows, shape="expand", body="column", row_key="id", schema="id long")
    p = Pipeline("anchors", [start, step(kids, shape="expand", body="column", row_key="k", schema="k int")])
    assert p.run(home).counts["kids"] == {"created": 2}
    assert home.links("child", "anchors", "kids").count() == 4
    with pytest.raises(ValueError, match="repeated row key"):
        Pipeline("twins", [start, step(twins, shape="expand", body="column", row_key="k", schema="k int")]).run(home)


def test_equal_values_share_an_address(home):
    """A first run may store an address twice, if two lanes have one value; it is still one output, with one edge."""

    def rows(spark):
        return spark.range(6).select("id", (F.col("id") % 2).alias("g"))

    def parity(rows):
        return F.struct(rows.g.alias("g"))

    def named(parity):
        return F.struct(F.when(parity.g == 0, "even").otherwise("odd").alias("name"))

    def count(named):
        return F.struct(F.count("*").alias("n"))

    p = Pipeline("twice", [
        step(rows, shape="expand", body="column", row_key="id", schema="id long, g long"), step(parity, body="column", schema="g long"), step(named, body="column", schema="name string"),
        step(count, body="column", group_key="name"),
    ])
    assert p.run(home).counts["named"] == {"created": 6}
    held = {r["step"]: r["n"] for r in home.outputs("twice").where("lane <> '@anchor'").groupBy("step").agg(F.count("*").alias("n")).collect()}
    assert held == {"rows": 6, "parity": 6, "named": 2, "count": 2}
    assert home.links("edge", "twice", "count").count() == 2
    assert p.run(home).reused == 6 + 6 + 6 + 2


def test_repeated_row_key(home):
    def rows(spark):
        return spark.createDataFrame([(1, "a"), (1, "b")], "id long, s string")

    with pytest.raises(ValueError, match="repeated row key"):
        Pipeline("keys", [step(rows, shape="expand", body="column", row_key="id", schema="id long, s string")]).run(home)


def test_invalidating_one_step_leaves_others(home):
    """The log names steps: what is dead in one isn't looked for in another, and a second storing revives it."""
    from lanewright import lineage

    def rows(spark):
        return spark.range(4).select("id")

    def twice(rows):
        return F.struct((rows.id * 2).alias("v"))

    p = Pipeline("dead", [step(rows, shape="expand", body="column", row_key="id", schema="id long"), step(twice, body="column", schema="v long")])
    p.run(home)
    lineage.invalidate(home, "step:twice v:4", "wrong")
    alive = lambda name: sorted(r["live"] for r in home.outputs("dead", name).where("lane <> '@anchor'").collect())
    assert alive("rows") == [True] * 4 and alive("twice") == [False, True, True, True]
    assert home.outputs("dead").where("NOT live").count() == 1
    assert p.run(home).counts["twice"] == {"created": 1, "reused": 3}
    assert alive("twice") == [True] * 4
