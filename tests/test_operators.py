from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewright import Pipeline, sources, spec, step
from lanewright.envcheck import env_reads
from lanewright.functions import scalars
from lanewright.functions.identity import canonical, canonical_text, sha
from lanewright.operators import expand, graph, groups, joins, sampling
from lanewright.selection import Selection


def test_canonical_json_of_columns_and_values_agree(spark):
    value = {"b": [1, 2], "a": {"y": None, "x": "é\"q"}, "n": True}
    frame = spark.range(1).select(F.struct(F.array(F.lit(1), F.lit(2)).alias("b"), F.struct(F.lit(None).cast("string").alias("y"), F.lit("é\"q").alias("x")).alias("a"), F.lit(True).alias("n")).alias("v"))
    assert frame.select(canonical(F.col("v"))).first()[0] == canonical_text(value)
    assert frame.select(sha(canonical(F.lit("s")))).first()[0] == frame.select(F.sha2(F.lit('"s"'), 256)).first()[0]


def test_joins(spark):
    left = spark.createDataFrame([("1", 1, "A1"), ("2", 1, "A2"), ("3", 2, "A3")], "lane string, id int, v string")
    right = spark.createDataFrame([("1", "1", "B1"), ("2", "1", "B2"), ("3", "9", "B9")], "lane string, id string, v string")
    sides = [("a", left, F.col("id")), ("b", right, F.col("id"))]
    assert sorted(r["lane"] for r in joins.star_join(sides).collect()) == ["1|1", "1|2", "2|1", "2|2"]
    assert sorted(r["lane"] for r in joins.star_join(sides, "union").collect()) == ["1|1", "1|2", "2|1", "2|2", "3|@missing", "@missing|3"]
    assert [(r["_key"], r["product"]) for r in joins.duplicate_keys(sides).collect()] == [("1", 4)]
    null = left.union(spark.createDataFrame([("4", None, "x")], left.schema))
    with pytest.raises(Exception, match="null join key"):
        joins.star_join([("a", null, F.col("id")), ("b", right, F.col("id"))]).collect()
    tags = spark.createDataFrame([("1", ["x", "y", "x"]), ("2", ["y"])], "lane string, tags array<string>")
    got = joins.star_join([("a", tags, F.col("tags")), ("b", tags, F.col("tags"))])
    assert sorted(r["lane"] for r in got.collect()) == ["1|1", "1|2", "2|1", "2|2"]
    with pytest.raises(Exception, match="disjoint"):
        joins.lane_join([("a", left), ("b", right.where("lane <> '3'"))]).collect()


def test_table_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "k int, r string")
    assert joins.table_join(a, b, "k", "k").collect() == [(1, "a", "x")]
    assert sorted(map(tuple, joins.table_join(a, b, "k", "k", "union").collect())) == [(1, "a", "x"), (2, "b", None), (3, None, "z")]
    with pytest.raises(ValueError, match="no column"):
        joins.table_join(a, b, "q", "k")
    with pytest.raises(Exception, match="null join key"):
        joins.table_join(a.union(spark.createDataFrame([(None, "n")], a.schema)), b, "k", "k").collect()


def test_groups(spark):
    rows = spark.createDataFrame([("b", ["t", "u"], 1), ("a", ["t"], 2)], "lane string, tags array<string>, v int")
    assert sorted(map(tuple, groups.aggregate(rows, F.col("tags"), [F.sum("v").alias("s")]).collect())) == [("t", 3), ("u", 1)]
    assert groups.aggregate(rows.where("false"), None, [F.count("*").alias("n")]).collect() == [("@all", 0)]
    folded = groups.fold(rows, None, F.lit(""), lambda acc, v: F.concat(acc, v.cast("string")), F.col("v"))
    assert folded.first()["value"] == "21"
    one = spark.createDataFrame([("a", 1)], "lane string, x int")
    two = spark.createDataFrame([("a", 2, "n"), ("b", 3, "n")], "lane string, x int, y string")
    assert sorted(map(tuple, groups.union_lanes([one, two]).collect())) == [("a", 1, None), ("b", 3, "n")]


def test_expand(spark):
    rows = spark.createDataFrame([(["x", "y"],), (["y"],)], "p array<string>")
    assert expand.expand(rows, F.col("p")).count() == 2
    keyed = sources.packed(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    assert expand.mint(keyed).count() == 2
    with pytest.raises(Exception, match="repeated row key"):
        expand.mint(keyed, "k").collect()
    with pytest.raises(Exception, match="null row key"):
        expand.mint(sources.packed(spark.createDataFrame([(None, "a")], "k int, v string")), "k").collect()


def test_samples(spark):
    rows = spark.range(200).select(F.format_string("row-%03d", "id").alias("lane"))
    small, large = (sampling.sample_fraction(rows, f, "s") for f in (0.2, 0.5))
    assert small.join(large, "lane", "left_anti").count() == 0 and 0 < small.count() < large.count()
    assert sampling.sample_n(rows, 7, "s").count() == 7
    for call in (lambda: sampling.sample_n(rows, -1, "s"), lambda: sampling.sample_n(rows, 1, ""), lambda: sampling.sample_fraction(rows, 2, "s")):
        with pytest.raises(ValueError):
            call()


def test_closure_stops_on_cycles(spark, home):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("x", "y")], "a string, b string")
    got = graph.closure(edges, spark.createDataFrame([("a",)], "node string"), home.cut)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]


def test_scalars(spark):
    assert scalars.seconds("24h") == 86400 and scalars.per_second("30/min") == 0.5 and scalars.size_bytes("500MB") == 500 << 20
    for bad in (lambda: scalars.seconds("x"), lambda: scalars.per_second("10"), lambda: scalars.size_bytes("much")):
        with pytest.raises(ValueError):
            bad()
    assert scalars.versions_matching(["1.0.0", "2.1.0", "legacy-v1"], "<2.0") == ["1.0.0"] and scalars.versions_matching(["1"], "what") == []
    rows = spark.createDataFrame([('{"a":{"b":"x1"},"t":["p","q"]}',), ('{"a":{"b":"y"}}',)], "o string")
    count = lambda path, value: rows.where(scalars.field_matches(F.col("o"), path, value)).count()
    assert [count("a.b", "x1"), count("a.b", "?"), count("t", "q"), count("t", "z"), count("none", "1")] == [1, 1, 1, 0, 0]


def test_selection_parse():
    s = Selection.parse("step:tier coord:row-1 'name:a b' meta.x:1")
    assert s.terms == {"step": "tier", "coordinate": "row-1"} and s.fields == [("name", "a b"), ("meta.x", "1")]
    for bad in ("nothing", ":x", "live:maybe"):
        with pytest.raises(ValueError):
            Selection.parse(bad)


@pytest.mark.parametrize("options", [
    {"shape": "odd"}, {"shape": "map", "join_on": {"a": "k"}}, {"shape": "map", "group_key": "k"}, {"code": "what"}, {"join_mode": "left"}, {"shape": "join"}, {"version": "auto"}, {"retries": -1},
    {"use_cache": False, "force": True}, {"use_cache": False, "stale_after": "1h"}, {"force": True, "stale_after": "1h"}, {"on_failed": "ask"}, {"shape": "fold"}, {"fold_init": object()},
    {"shape": "map", "fold_init": 0}, {"shape": "aggregate", "use_cache": False}, {"shape": "expand", "as_table": True}, {"row_key": "k"}, {"assertions": [1]}, {"rate_limit": "fast"},
    {"stale_after": "soon"}, {"executor": "ray"}, {"join_mode": "union"}, {"shape": "expand", "use_cache": False},
])
def test_step_rules(options):
    with pytest.raises(ValueError):
        step(lambda a: a, name="s", **options)


def test_pipeline_rules():
    def root():
        yield 1

    def child(root):
        return root

    ok = [step(root), step(child)]
    assert [s.name for s in Pipeline("p", list(reversed(ok))).steps] == ["root", "child"]
    assert step(child)(5) == 5 and step(root).shape == "expand" and step(lambda root, k: 1, depends_on=["root", "child"]).depends_on == {"root": "root", "k": "child"}
    lonely = step(child, use_cache=False)
    for bad in ([*ok, step(root)], [step(child)], [step(root), lonely], [step(child, depends_on={"root": "child"})]):
        with pytest.raises(ValueError):
            Pipeline("p", bad)
    for wrong in ({"retention": 0}, {"schedule": "wide"}, {"env": ["A", "A"]}):
        with pytest.raises(ValueError):
            Pipeline("p", ok, **wrong)
    p = Pipeline("p", ok)
    assert "root --> child" in p.describe("mermaid") and "child (map, v1) <- root" in p.describe() and "`- child" in p.describe("ascii")
    assert spec.union("u", "a", "b").shape == "union"


def test_env_reads():
    source = "import os\ndef f():\n    return os.environ['A'], os.getenv('B'), os.environ.get('C', 1), other['D']"
    assert env_reads(source) == {"A", "B", "C"}


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
