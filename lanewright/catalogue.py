"""Named queries over the driver's tables, each with its SQL twin.

Steps, planning, lineage and storage are shown by pipelines that run in a fresh
home; what a query returns is read from that home's ledger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright import Home, Pipeline, lineage, selection, sources, step, storage, streaming
from lanewright.diff import classify
from lanewright.functions import scalars
from lanewright.functions.identity import canonical, sha
from lanewright.operators import expand, graph, groups, joins, sampling
from lanewright.plans.bodies import attempt, stored
from lanewright.session import shared_dir, ship
from lanewright.spec import Filtered, Step

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT CASE WHEN o_totalprice >= 250000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS tier,
           count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
    FROM orders GROUP BY 1""")
def map_classify_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of three steps: rows, their tier, a rollup by tier."""

    def tier(orders: Column) -> Column:
        name = F.when(orders.cents >= 25_000_000, "large").when(orders.cents >= 10_000_000, "medium").otherwise("small")
        return F.struct(name.alias("tier"), orders.cents.alias("cents"))

    def total(tier: Column) -> Column:
        return F.struct(F.count("*").alias("n_orders"), F.sum(tier.cents).alias("cents"))

    steps = [order_rows(spark, sf_dir), step(tier, body="column", schema="tier string, cents long"), step(total, body="column", group_key="tier")]
    return ran(spark, steps, "n_orders long, cents long").withColumnRenamed("lane", "tier")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def lanes(frame: DataFrame, key: str) -> DataFrame:
    """A frame whose lane is one of its columns."""
    return frame.withColumn("lane", F.col(key).cast("string"))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share."""
    return f"{shared_dir(spark)}/lanes-{uuid.uuid4().hex}"


# pipelines over the tables


def ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def source(frame: DataFrame, name: str, row_key: str | None = None, force: bool = False) -> Step:
    """A root whose lanes are a frame's rows."""
    return step(lambda: frame, name=name, shape="expand", body="column", row_key=row_key, schema=ddl(frame), force=force)


def fresh_home(spark: SparkSession) -> Home:
    return Home(spark, scratch_dir(spark))


def outputs(home: Home, pipeline: str, name: str, schema: str) -> DataFrame:
    """The live outputs of a step as columns, with their lane."""
    live = home.outputs(pipeline, name).where("live AND NOT filtered AND lane <> '@anchor'")
    return live.select("lane", F.from_json("output", schema).alias("v")).select("lane", "v.*")


def ran(spark: SparkSession, steps: list[Step], schema: str, params: dict | None = None) -> DataFrame:
    """Runs steps in a fresh home; the outputs of the last one."""
    home = fresh_home(spark)
    Pipeline("catalogue", steps).run(home, params)
    return outputs(home, "catalogue", steps[-1].name, schema)


def order_rows(spark: SparkSession, sf_dir: str) -> Step:
    kept = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long"), cents("o_totalprice").alias("cents"), "o_orderpriority")
    return source(kept, "orders", "o_orderkey")


# sources


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name FROM nation")
def source_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    table(spark, sf_dir, "nation").coalesce(1).write.csv(path, header=True)
    rows = sources.csv_rows(spark, path)
    return rows.select(F.col("output.n_nationkey").alias("nation"), F.col("output.n_name").alias("name"))


@query("SELECT r_name AS text FROM region")
def source_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(path)
    return sources.folder(spark, path, "*.txt").select(F.explode(F.split(F.trim("output.text"), "\\R")).alias("text"))


@query("SELECT count(*) AS n FROM region")
def source_object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    table(spark, sf_dir, "region").repartitionByRange(5, "r_regionkey").write.parquet(path)
    return sources.object_list(spark, path, "*.parquet").where("output.size > 0").agg(F.countDistinct("output.key").alias("n"))


@query("SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers")
def multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [sources.parquet_rows(spark, f"{sf_dir}/{t}.parquet").agg(F.count("*").alias(n)) for t, n in (("orders", "n_orders"), ("customer", "n_customers"))]
    return counts[0].crossJoin(counts[1])


# map family


@query("SELECT 10 AS threshold, 'eu' AS region")
def map_root_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    def config(params: dict) -> dict:
        return dict(params)

    return ran(spark, [step(config)], "threshold int, region string", {"threshold": 10, "region": "eu"}).drop("lane")


@query("SELECT CAST(c_custkey AS VARCHAR) AS lane, upper(c_name) AS name, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM customer")
def map_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lanes(table(spark, sf_dir, "customer"), "c_custkey")
    one = base.select("lane", F.upper("c_name").alias("name"))
    two = base.select("lane", F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("side"))
    return joins.lane_join([("one", one), ("two", two)]).select("lane", "one.name", "two.side")


@query("""
    SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (SELECT count(*) FROM orders) > (SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders) AS above
    FROM orders""")
def map_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against a step of one lane."""

    def whole(orders: Column) -> Column:
        return F.struct(F.count("*").alias("n"), F.sum(orders.cents).alias("s"))

    def above(orders: Column, whole: Column) -> Column:
        return F.struct(orders.o_orderkey.alias("o_orderkey"), (orders.cents * whole.n > whole.s).alias("above"))

    steps = [order_rows(spark, sf_dir), step(whole, shape="aggregate", body="column", schema="n long, s long"), step(above, body="column")]
    return ran(spark, steps, "o_orderkey long, above boolean").drop("lane")


def _cheap() -> Step:
    def dear(orders: Column) -> tuple[Column, Column, str]:
        return orders, orders.cents >= 5_000_000, "cheap"

    return step(dear, body="column", schema="o_orderkey long, cents long, o_orderpriority string")


@query("""
    SELECT o_orderkey, o_totalprice < 50000 AS filtered, CASE WHEN o_totalprice < 50000 THEN 'cheap' END AS reason FROM orders""")
def filter_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts are cells, with their reason."""
    home, rows = fresh_home(spark), order_rows(spark, sf_dir)
    Pipeline("verdicts", [rows, _cheap()]).run(home)
    verdicts = home.cells("verdicts", "dear").select("lane", (F.col("status") == "filtered").alias("filtered"), "reason")
    return outputs(home, "verdicts", "orders", rows.schema).join(verdicts, "lane").select("o_orderkey", "filtered", "reason")


@query("""
    SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT (o_totalprice < 50000) GROUP BY 1""")
def filter_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered rows are absent from the groups above them."""

    def total(dear: Column) -> Column:
        return F.struct(F.count("*").alias("n"))

    steps = [order_rows(spark, sf_dir), _cheap(), step(total, body="column", group_key="o_orderpriority")]
    return ran(spark, steps, "n long").withColumnRenamed("lane", "o_orderpriority")


@query("SELECT upper(replace(c_name, '#', '-')) || '!' AS name, c_custkey FROM customer")
def fused_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A helper that is never stored; its body joins its consumer's plan."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), "c_name")

    def plain(customers: Column) -> Column:
        return F.struct(customers.c_custkey.alias("c_custkey"), F.replace(customers["c_name"], F.lit("#"), F.lit("-")).alias("name"))

    def loud(plain: Column) -> Column:
        return F.struct(plain.c_custkey.alias("c_custkey"), F.concat(F.upper(plain["name"]), F.lit("!")).alias("name"))

    steps = [source(people, "customers", "c_custkey"), step(plain, body="column", schema="c_custkey long, name string", use_cache=False), step(loud, body="column")]
    return ran(spark, steps, "name string, c_custkey long").drop("lane")


@query("SELECT p_partkey, p_name, length(p_name) AS name_length FROM part")
def row_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table value, and a step that adds a column to its rows."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    def parts() -> DataFrame:
        return rows

    def name_length(parts: Column) -> Column:
        return F.length(parts.p_name).cast("long")

    found = ran(spark, [step(parts, as_table=True), step(name_length, as_table=True, body="rows")], "`$table` string").first()
    return spark.read.parquet(found["$table"])


@query("""
    SELECT l_linenumber % 3 = 0 AS failed, count(*) AS n, CASE WHEN l_linenumber % 3 = 0 THEN 'ValueError' END AS error_type FROM lineitem GROUP BY 1, 3""")
def error_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)

    def body(lineitem: int) -> int:
        if lineitem % 3 == 0:
            raise ValueError("every third")
        return lineitem

    checked = step(body, depends_on=["lineitem"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [attempt(checked, lambda v=v: body(v), stored) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[4] is not None for m in made]), pa.array([m[5] for m in made], pa.string())], names=["failed", "error_type"])

    ran = table(spark, sf_dir, "lineitem").select("l_linenumber").mapInArrow(work, "failed boolean, error_type string")
    return ran.groupBy("failed", "error_type").agg(F.count("*").alias("n"))


# expand


@query("""
    SELECT 'row-' || sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}') AS lane, n_name AS name FROM nation""")
def expand_lane_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return expand.mint(table(spark, sf_dir, "nation").select(payload.alias("output"))).select("lane", "output.name")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def expand_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal payloads are one lane."""
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text")
    return ran(spark, [source(texts, "texts")], "text string").select(sha(F.col("text")).alias("hash"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def expand_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.expand(table(spark, sf_dir, "part"), F.split("p_name", " ")).select(F.col("output").alias("word"))


@query("SELECT 'row-' || sha256(CAST(n_nationkey AS VARCHAR)) AS lane, n_name AS name FROM nation")
def expand_row_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.packed(table(spark, sf_dir, "nation"))
    return expand.mint(rows, "n_nationkey").select("lane", F.col("output.n_name").alias("name"))


@query("SELECT conv_id, count(DISTINCT sha256(text)) AS n_children, min(sha256(text)) AS first_child FROM conversations GROUP BY conv_id")
def expand_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of each parent, by the ledger's edges; equal children of two parents are one lane."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("long")).agg(F.collect_list("text").alias("texts"))

    def said(talks: Column) -> Column:
        return F.transform(talks.texts, lambda t: F.struct(t.alias("text")))

    home, talks = fresh_home(spark), source(turns, "talks", "conv_id")
    Pipeline("talks", [talks, step(said, shape="expand", body="column")]).run(home)
    live = home.outputs("talks").where("live AND lane <> '@anchor'").select("step", "address", "output")
    parents = live.where("step = 'talks'").select(F.col("address").alias("parent"), F.get_json_object("output", "$.conv_id").cast("long").alias("conv_id"))
    children = live.where("step = 'said'").select(F.col("address").alias("child"), sha(F.get_json_object("output", "$.text")).alias("h"))
    return home.edges().join(parents, "parent").join(children, "child").groupBy("conv_id").agg(F.count("*").alias("n_children"), F.min("h").alias("first_child"))


# unions


@query("""
    WITH a AS (SELECT s_suppkey AS k, s_name AS name, 0 AS ord FROM supplier UNION ALL SELECT p_partkey, upper(p_name), 1 FROM part)
    SELECT CAST(k AS VARCHAR) AS lane, arg_min(name, ord) AS name FROM a GROUP BY k""")
def union_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lanes(table(spark, sf_dir, "supplier"), "s_suppkey").select("lane", F.col("s_name").alias("name"))
    two = lanes(table(spark, sf_dir, "part"), "p_partkey").select("lane", F.upper("p_name").alias("name"))
    return groups.union_lanes([one, two])


@query("SELECT 'n' || n_nationkey AS lane, n_name AS name, NULL::INTEGER AS size FROM nation UNION ALL SELECT 'p' || p_partkey, NULL, p_size FROM part")
def union_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("lane"), F.col("n_name").alias("name"))
    two = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("lane"), F.col("p_size").alias("size"))
    return groups.union_lanes([one, two])


# joins


def _orders_customers(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, Column]]:
    orders = lanes(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    people = lanes(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return [("o", orders, F.col("o_custkey")), ("c", people, F.col("c_custkey"))]


@query("SELECT o_orderkey || '|' || c_custkey AS lane, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.star_join(_orders_customers(spark, sf_dir)).select("lane", F.col("c.c_name").alias("name"))


@query("""
    WITH l AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CAST(l.k AS VARCHAR) AS key, l.n AS n_part, r.n AS n_supp, l.n * r.n AS product FROM l JOIN r ON l.k = r.k WHERE l.n > 1 AND r.n > 1""")
def join_inner_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    found = joins.duplicate_keys([("part", items, F.col("l_partkey")), ("supp", items, F.col("l_suppkey"))])
    return found.withColumnRenamed("_key", "key")


@query("""
    SELECT coalesce(CAST(p_partkey AS VARCHAR), '@missing') || '|' || coalesce(CAST(n_nationkey AS VARCHAR), '@missing') AS lane, p_name, n_name
    FROM part FULL JOIN nation ON p_size = n_nationkey""")
def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and nations by a number that both have; either side has numbers of its own."""
    parts = lanes(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    nations = lanes(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return joins.star_join([("p", parts, F.col("p_size")), ("n", nations, F.col("n_nationkey"))], "union").select("lane", "p.p_name", "n.n_name")


@query("""
    SELECT coalesce(CAST(p_partkey AS VARCHAR), '@missing') || '|' || coalesce(CAST(n_nationkey AS VARCHAR), '@missing') || '|' || coalesce(CAST(r_regionkey AS VARCHAR), '@missing') AS lane
    FROM part FULL JOIN nation ON p_size = n_nationkey FULL JOIN region ON coalesce(p_size, n_nationkey) = r_regionkey""")
def join_outer_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [("part", "p_partkey", "p_size"), ("nation", "n_nationkey", "n_nationkey"), ("region", "r_regionkey", "r_regionkey")]
    return joins.star_join([(t, lanes(table(spark, sf_dir, t), lane), F.col(key)) for t, lane, key in sides], "union").select("lane")


@query("""
    WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), v AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS word FROM part)
    SELECT p_partkey || '|' || v.word AS lane FROM w JOIN v ON w.word = v.word""")
def join_list_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lanes(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    words = parts.select(F.split("p_name", " ")[0].alias("word")).distinct().withColumn("lane", F.col("word"))
    return joins.star_join([("p", parts, F.split("p_name", " ")), ("w", words, F.col("word"))]).select("lane")


@query("""
    SELECT '{"c":{"name":"' || c_name || '"},"o":{"order":' || o_orderkey || '}}' AS output FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.star_join(_orders_customers(spark, sf_dir))
    nested = F.struct(F.struct(F.col("o.o_orderkey").alias("order")).alias("o"), F.struct(F.col("c.c_name").alias("name")).alias("c"))
    return rows.select(canonical(nested).alias("output"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outer join whose matched pairs a filter takes out."""
    docs, labels = (source(table(spark, sf_dir, t).select(F.col("doc_id").cast("long")), t, "doc_id") for t in ("documents", "labels"))

    def unlabelled(documents: Column, labels: Column) -> tuple[Column, Column, str]:
        return F.struct(documents.doc_id.alias("doc_id")), documents.doc_id.isNotNull() & labels.doc_id.isNull(), "labelled"

    made = step(unlabelled, join_on={"documents": "doc_id", "labels": "doc_id"}, join_mode="union", body="column")
    return ran(spark, [docs, labels, made], "doc_id long").drop("lane")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return joins.existence_join(docs, table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("SELECT n_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_table_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    return joins.table_join(nation, table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")


@query("""
    SELECT coalesce(p_size, n_nationkey) AS p_size, p_name, n_name FROM part FULL JOIN nation ON p_size = n_nationkey""")
def join_table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_size", "p_name")
    return joins.table_join(parts, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "p_size", "n_nationkey", "union")


# aggregates and folds


@query("SELECT '@all' AS \"group\", count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders")
def agg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.aggregate(table(spark, sf_dir, "orders"), None, [F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("cents")])


@query("SELECT '@all' AS \"group\", count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderkey < 0")
def agg_all_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.aggregate(table(spark, sf_dir, "orders").where("o_orderkey < 0"), None, [F.count("*").alias("n"), F.sum("o_orderkey").cast("decimal(38,0)").alias("s")])


@query("""
    SELECT l_returnflag AS "group", count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1""")
def agg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.aggregate(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), [F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("cents")])


@query("""
    WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word AS "group", count(*) AS n FROM w GROUP BY 1""")
def agg_group_multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.aggregate(table(spark, sf_dir, "part"), F.split("p_name", " "), [F.count("*").alias("n")])


@query("""
    WITH o AS (SELECT c_nationkey AS k, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
         s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1)
    SELECT CAST(coalesce(o.k, s.k) AS VARCHAR) AS "group", n_orders, n_suppliers FROM o FULL JOIN s ON o.k = s.k""")
def agg_two_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return groups.cogrouped([
        ("orders", orders, F.col("c_nationkey"), [F.count("*").alias("n_orders")]),
        ("suppliers", table(spark, sf_dir, "supplier"), F.col("s_nationkey"), [F.count("*").alias("n_suppliers")]),
    ])


@query("SELECT count(*) AS n, count(DISTINCT p_brand) AS n_brands, max(p_size) AS max_size FROM part")
def agg_table_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate whose body gets its parent's lanes as a frame."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), "p_brand", F.col("p_size").cast("int"))

    def stats(parts: DataFrame) -> DataFrame:
        return parts.agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("n_brands"), F.max("p_size").alias("max_size"))

    return ran(spark, [source(rows, "parts", "p_partkey"), step(stats, shape="aggregate", body="table")], "n long, n_brands long, max_size int").drop("lane")


@query("SELECT CAST(conv_id AS VARCHAR) AS \"group\", string_agg(substr(role, 1, 1), '' ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def fold_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("lane", F.lpad(F.col("turn").cast("string"), 12, "0"))
    return groups.fold(turns, F.col("conv_id"), F.lit(""), lambda acc, v: F.concat(acc, v), F.substring("role", 1, 1))


@query("SELECT event_type AS \"group\", sum(CAST(round(value * 100) AS BIGINT)) AS value FROM events GROUP BY 1")
def fold_group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commutative fold is an aggregate."""
    return groups.aggregate(table(spark, sf_dir, "events"), F.col("event_type"), [F.sum(cents("value")).alias("value")])


# samples


@query("SELECT doc_id FROM documents ORDER BY sha256('seed' || chr(0) || doc_id), CAST(doc_id AS VARCHAR) LIMIT 50")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_n(lanes(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), 50, "seed").select("doc_id")


@query(f"SELECT o_orderkey FROM orders WHERE sha256('seed' || chr(0) || o_orderkey) < '{sampling.threshold(0.25)}'")
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_fraction(lanes(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), 0.25, "seed").select("o_orderkey")


@query(f"""
    SELECT count(*) FILTER (WHERE h < '{sampling.threshold(0.1)}') AS n_small, count(*) FILTER (WHERE h < '{sampling.threshold(0.4)}') AS n_large,
           count(*) FILTER (WHERE h < '{sampling.threshold(0.1)}') AS n_both FROM (SELECT sha256('s' || chr(0) || o_orderkey) AS h FROM orders)""")
def sample_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller sample of one seed is part of a larger one."""
    orders = lanes(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    small, large = (sampling.sample_fraction(orders, f, "s").withColumn(n, F.lit(1)) for f, n in ((0.1, "a"), (0.4, "b")))
    return small.join(large, "lane", "full").agg(F.count("a").alias("n_small"), F.count("b").alias("n_large"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


@query("SELECT n_name, (SELECT count(*) FROM nation) AS total FROM nation ORDER BY n_name LIMIT 10 OFFSET 5")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a pipeline's current outputs, and how many there are."""
    home = fresh_home(spark)
    Pipeline("nations", [source(table(spark, sf_dir, "nation").select("n_name"), "nations", "n_name")]).run(home)
    rows, total = selection.page(selection.current(home).select(F.get_json_object("output", "$.n_name").alias("n_name")), ["n_name"], 10, 5)
    return rows.withColumn("total", F.lit(total).cast("long"))


# selection


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_field_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(scalars.field_matches(F.col("props"), "k", "42")).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_name GLOB '*1?'")
def glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(scalars.glob(F.col("c_name"), "*1?")).select("c_custkey")


@query("SELECT o_orderkey, o_orderkey % 4 || '.1' AS version FROM orders WHERE o_orderkey % 4 IN (1, 2)")
def version_range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit(".1")).alias("version"))
    known = [r["version"] for r in rows.select("version").distinct().collect()]
    return rows.where(F.col("version").isin(scalars.versions_matching(known, ">=1,<3")))


# planning, lineage, differences


@query("""
    WITH t AS (SELECT CASE WHEN o_totalprice >= 250000 THEN 'execute' ELSE 'reuse' END AS action, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'tier' AS step, action, n FROM t UNION ALL SELECT 'orders', 'reuse', 1 UNION ALL SELECT 'total', 'pending', 1""")
def reuse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan after some outputs of a step were invalidated; nothing above it runs, what is below waits for it."""

    def tier(orders: Column) -> Column:
        return F.struct(F.when(orders.cents >= 25_000_000, "large").otherwise("small").alias("tier"), orders.o_orderkey.alias("id"))

    def total(tier: Column) -> Column:
        return F.struct(F.count("*").alias("n"))

    home = fresh_home(spark)
    pipeline = Pipeline("orders", [order_rows(spark, sf_dir), step(tier, body="column", schema="tier string, id long"), step(total, body="column", group_key="tier")])
    pipeline.run(home)
    lineage.invalidate(home, "step:tier tier:large", "for the plan")
    return pipeline.plan(home).groupBy("step", "action").agg(F.count("*").alias("n"))


def _shop(changed: int, name: str = "shop") -> Pipeline:
    """nation rows, those of one region changed, classified and counted by region."""

    def rows(spark: SparkSession) -> DataFrame:
        return spark.table("lanewright_nation").withColumn("mark", F.when(F.col("n_regionkey") == changed, 2).otherwise(1))

    def kind(rows: Column) -> Column:
        return F.struct(rows.n_regionkey.alias("region"), (rows.mark + 0).alias("mark"))

    def total(kind: Column) -> Column:
        return F.struct(F.sum(kind.mark).alias("marks"))

    schema = "n_nationkey int, n_name string, n_regionkey int, mark int"
    return Pipeline(name, [
        step(rows, shape="expand", body="column", schema=schema, force=True),
        step(kind, body="column", schema="region int, mark int"),
        step(total, body="column", group_key="region"),
    ])


@query("""
    WITH n AS (SELECT count(*) FILTER (WHERE n_regionkey = 1) AS c, count(*) AS a, count(DISTINCT n_regionkey) AS g FROM nation)
    SELECT unnest(['rows', 'kind', 'total']) AS step, unnest([c, c, 1]) AS created, unnest([a - c, a - c, g - 1]) AS reused FROM n""")
def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline run twice; between the runs the rows of one region change."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lanewright_nation")
    home = Home(spark, scratch_dir(spark))
    _shop(-1).run(home)
    second = _shop(1).run(home)
    cells = home.cells(run_id=second.run_id).where("lane <> '@anchor'")
    return cells.groupBy("step").agg(F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "reused").alias("reused"))


@query("""
    WITH n AS (SELECT count(*) FILTER (WHERE n_regionkey = 2) AS c, count(*) AS a FROM nation)
    SELECT unnest(['rows', 'loud', 'greeting']) AS step, unnest([c, c, 0]) AS created, unnest([a - c, a - c, a]) AS reused, unnest([c, c, 0]) AS executed FROM n""")
def early_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs change, so a step runs, but its outputs do not, so nothing below it runs."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("name"))

    def loud(rows: Column) -> Column:
        return F.struct(rows.n_nationkey.alias("id"), F.upper(rows["name"]).alias("name"))

    def greeting(loud: Column) -> Column:
        return F.struct(F.concat(F.lit("HELLO "), loud["name"]).alias("text"), loud.id.alias("id"))

    home = fresh_home(spark)
    for name in (F.col("name"), F.when(F.col("n_regionkey") == 2, F.lower("name")).otherwise(F.col("name"))):
        rows = source(nations.withColumn("name", name), "rows", force=True)
        last = Pipeline("greet", [rows, step(loud, body="column", schema="id int, name string"), step(greeting, body="column")]).run(home)
    cells = home.cells(run_id=last.run_id).where("lane <> '@anchor'")
    made = [F.count_if(F.col("status") == x).alias(x) for x in ("created", "reused")]
    executed = F.count_if((F.col("attempts") > 0) & ((F.col("step") != "rows") | F.col("fresh"))).alias("executed")
    return cells.groupBy("step").agg(*made, executed)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = [("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    found = [table(spark, sf_dir, t).select(name(a, ka).alias("a"), name(b, kb).alias("b")) for t, a, ka, b, kb in parts]
    return found[0].union(found[1]).union(found[2])


@query("""
    WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    t AS (SELECT DISTINCT a AS node, 0 AS depth FROM e WHERE a IN ('o1', 'o2', 'o3', 'n3') UNION SELECT e.b, t.depth + 1 FROM t JOIN e ON e.a = t.node)
    SELECT node, min(depth) AS depth FROM t GROUP BY node""")
def trace_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    seeds = edges.where(F.col("a").isin("o1", "o2", "o3", "n3")).select(F.col("a").alias("node"))
    return graph.closure(edges, seeds, Home(spark, scratch_dir(spark)).cut)


@query("""
    WITH n AS (SELECT count(*) FILTER (WHERE n_regionkey = 3) AS c, count(*) AS a, count(DISTINCT n_regionkey) AS g FROM nation)
    SELECT unnest(['rows', 'kind', 'total']) AS step, unnest([c, c, 1]) AS dead, unnest([a - c, a - c, g - 1]) AS live FROM n""")
def invalidate_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one region, and all that was made from them, are no longer live."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lanewright_nation")
    home = fresh_home(spark)
    _shop(-1).run(home)
    lineage.invalidate(home, "step:rows n_regionkey:3", "wrong", downstream=True)
    return _liveness(home)


def _liveness(home: Home) -> DataFrame:
    held = home.outputs().where("lane <> '@anchor'")
    return held.groupBy("step").agg(F.count_if(~F.col("live")).alias("dead"), F.count_if("live").alias("live"))


@query("""
    WITH c AS (SELECT c_nationkey AS k FROM customer), o AS (SELECT c_nationkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT 'n' AS kind, count(*) AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'c', count(*) FROM c WHERE k = 3 UNION ALL SELECT 'o', count(*) FROM o WHERE k = 3""")
def closure_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).select(F.col("b").alias("a"), F.col("a").alias("b"))
    found = graph.closure(edges, spark.range(1).select(F.lit("n3").alias("node")), fresh_home(spark).cut)
    return found.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("""
    WITH n AS (SELECT * FROM nation WHERE n_regionkey = 1)
    SELECT 'upstream' AS relation, 'rows' AS step, 1 AS depth, count(*) AS n FROM n UNION ALL SELECT 'seed', 'kind', 0, count(*) FROM n UNION ALL SELECT 'downstream', 'total', 1, 1""")
def trace_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the outputs of one step came from and went into."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lanewright_nation")
    home = fresh_home(spark)
    _shop(-1).run(home)
    found = lineage.trace(home, "step:kind region:1").where("step IS NOT NULL")
    return found.groupBy("relation", "step", F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("n"))


@query("""
    WITH a AS (SELECT n_nationkey AS k, n_regionkey AS v FROM nation), b AS (SELECT DISTINCT p_size AS k, p_size % 5 AS v FROM part)
    SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = lambda f, v: f.select("lane", F.lit("created").alias("status"), sha(v.cast("string")).alias("identity"), v.cast("string").alias("output"))
    old = cells(lanes(table(spark, sf_dir, "nation"), "n_nationkey"), F.col("n_regionkey"))
    new = cells(lanes(table(spark, sf_dir, "part").select("p_size").distinct(), "p_size"), F.col("p_size") % 5)
    return classify(old, new).groupBy("change").agg(F.count("*").alias("n"))


# views of the ledger, on events


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "ts")


@query("""
    WITH n AS (SELECT count(*) FILTER (WHERE n_regionkey = 1) AS c, count(*) AS a, count(DISTINCT n_regionkey) AS g FROM nation)
    SELECT unnest(['rows', 'kind', 'total']) AS step, unnest([c, c, 1]) AS dead, unnest([a, a, g]) AS live FROM n""")
def retention_keep_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collecting garbage with the last run kept: what only the run before used goes."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lanewright_nation")
    home = fresh_home(spark)
    _shop(-1).run(home)
    _shop(1).run(home)
    storage.gc(home, retention=1)
    return _liveness(home)


@query("""
    WITH r AS (SELECT '{"mark":1,"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS v FROM nation),
    k AS (SELECT '{"mark":1,"region":' || n_regionkey || '}' AS v FROM nation), t AS (SELECT '{"marks":' || count(*) || '}' AS v FROM nation GROUP BY n_regionkey),
    s AS (SELECT 'rows' AS step, v FROM r UNION ALL SELECT 'kind', v FROM k UNION ALL SELECT 'total', v FROM t),
    u AS (SELECT step, count(*) AS n_rows, count(DISTINCT v) AS n_values FROM s GROUP BY step),
    b AS (SELECT step, sum(strlen(v)) AS bytes FROM (SELECT DISTINCT step, v FROM s) GROUP BY step),
    x AS (SELECT 'shop' AS pipeline, step, n_rows, n_values, bytes FROM u JOIN b USING (step))
    SELECT * FROM x UNION ALL SELECT 'shop', NULL, sum(n_rows), sum(n_values), sum(bytes) FROM x UNION ALL SELECT NULL, NULL, sum(n_rows), sum(n_values), sum(bytes) FROM x""")
def storage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a home holds after a run: rows, distinct values and their bytes in each scope."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lanewright_nation")
    home = fresh_home(spark)
    _shop(-1).run(home)
    return storage.usage(home).select("pipeline", "step", "n_rows", "n_values", "bytes")


@query("""
    WITH c AS (SELECT CASE n_regionkey WHEN 0 THEN 'failed' WHEN 1 THEN 'filtered' ELSE 'created' END AS s, count(*) AS n FROM nation GROUP BY 1)
    SELECT 'nations' AS step, (SELECT sum(n) FROM c)::BIGINT AS created, 0 AS failed, 0 AS filtered, 0 AS blocked
    UNION ALL SELECT 'picky', sum(n) FILTER (WHERE s = 'created'), sum(n) FILTER (WHERE s = 'failed'), sum(n) FILTER (WHERE s = 'filtered'), 0 FROM c
    UNION ALL SELECT 'after', sum(n) FILTER (WHERE s = 'created'), 0, sum(n) FILTER (WHERE s = 'filtered'), sum(n) FILTER (WHERE s = 'failed') FROM c""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a run's cells: errors are kept by row, and block what depends on them."""

    def picky(nations: dict) -> object:
        if nations["n_regionkey"] == 0:
            raise ValueError("not this region")
        return Filtered("nor that") if nations["n_regionkey"] == 1 else nations["n_name"]

    def after(picky: str) -> str:
        return picky.lower()

    home = fresh_home(spark)
    nations = source(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name"), "nations", "n_nationkey")
    last = Pipeline("states", [nations, step(picky), step(after)]).run(home)
    cells = home.cells(run_id=last.run_id).where("lane <> '@anchor'")
    return cells.groupBy("step").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("created", "failed", "filtered", "blocked")])


# extras that Spark brings along; not capabilities of the reference


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = streaming.tumbling(table(spark, sf_dir, "events"), "1 day", ["event_type"])
    return windows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users FROM events")
def stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream until nothing is new, then counted."""
    events, out = table(spark, sf_dir, "events"), scratch_dir(spark)
    streaming.drain(spark, sf_dir, events.schema.simpleString()[7:-1].replace(":", " "), f"{out}/state", lambda b, i: b.write.parquet(f"{out}/data/{i}"), pathGlobFilter="events.parquet")
    return spark.read.parquet(f"{out}/data/*").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
