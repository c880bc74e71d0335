"""The engine's operators as registered queries on the common tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.errors import EngineError
from tessella.operators import changes, federation, integrity, metrics, query, revisions, search, views
from tessella.plans.binding import Documents
from tessella.plans.compile import condition, truth
from tessella.plans.predicate import parse
from tessella.sources import documents as source
from tessella.sources.checkpoints import durable, scratch
from tessella.streaming import subscription
from tessella.streaming.materialized import MaterializedView

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_IDS = {"orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "customer": "c_custkey", "supplier": "s_suppkey", "documents": "doc_id", "nation": "n_nationkey"}


def _registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str, **more: Any) -> Documents:
    return source.table(spark, f"{sf_dir}/{name}.parquet", _IDS[name], **more)


def _page(docs: Documents, request: dict[str, Any], fields: list[str]) -> DataFrame:
    return query.page(docs, request).select(docs.id_column().alias("id"), *query.columns(docs, docs.df, fields))


# Selectors


@_registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50""")
def sel_eq_range_sort(spark, sf_dir):
    request = {"selector": {"/o_orderstatus": "F", "/o_totalprice": {"$gte": 200000}}, "sort": [{"path": "/o_totalprice", "direction": "desc"}], "limit": 50}
    return _page(_docs(spark, sf_dir, "orders"), request, ["/o_orderstatus", "/o_totalprice"])


def _where(docs: Documents, selector: dict[str, Any], *columns: str) -> DataFrame:
    return docs.df.where(condition(parse(selector), docs)).select(docs.id_column().alias("id"), *columns)


@_registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice < 1000) AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')
  AND NOT (o_totalprice > 300000 OR o_custkey <= 10)""")
def sel_in_nin_or_nor(spark, sf_dir):
    selector = {
        "$or": [{"/o_orderstatus": {"$in": ["F", "P"]}}, {"/o_totalprice": {"$lt": 1000}}],
        "/o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]},
        "$nor": [{"/o_totalprice": {"$gt": 300000}}, {"/o_custkey": {"$lte": 10}}],
    }
    return _where(_docs(spark, sf_dir, "orders"), selector, "o_orderstatus", "o_orderpriority")


@_registered("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_type FROM part
WHERE starts_with(p_brand, 'Brand#1') AND regexp_matches(p_type, '[A-Z]+$') AND p_name <> 'none'""")
def sel_prefix_regex(spark, sf_dir):
    selector = {"/p_brand": {"$beginsWith": "Brand#1"}, "/p_type": {"$regex": "[A-Z]+$"}, "/p_name": {"$ne": "none"}}
    return _where(_docs(spark, sf_dir, "part"), selector, "p_name", "p_type")


@_registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND (o_totalprice > 100000 AND o_totalprice <= 150000) AND (o_orderpriority = '2-HIGH' OR o_custkey < 100)""")
def sel_and(spark, sf_dir):
    selector = {"$and": [{"/o_orderstatus": "O"}, {"$and": [{"/o_totalprice": {"$gt": 100000}}, {"/o_totalprice": {"$lte": 150000}}]}, {"$or": [{"/o_orderpriority": "2-HIGH"}, {"/o_custkey": {"$lt": 100}}]}]}
    return _where(_docs(spark, sf_dir, "orders"), selector, "o_totalprice")


@_registered("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size FROM part WHERE p_size > 40 ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 120")
def page_default_order(spark, sf_dir):
    """Without a sort, the order of ids."""
    return _page(_docs(spark, sf_dir, "part"), {"selector": {"/p_size": {"$gt": 40}}, "limit": 120}, ["/p_size"])


@_registered("""
SELECT 50 AS results, true AS has_more, 51 AS examined, true AS marked, 'bounded_scan' AS plan_kind, (SELECT min(id) FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 50)) AS first""")
def page_envelope(spark, sf_dir):
    """What an answer says of itself."""
    got = query.execute(_docs(spark, sf_dir, "orders"), {"selector": {"/o_orderstatus": "F"}})
    row = (len(got["results"]), got["has_more"], got["examined"], got["bookmark"] is not None, got["plan_kind"], got["documents"][0]["id"])
    return spark.createDataFrame([row], "results int, has_more boolean, examined int, marked boolean, plan_kind string, first string")


@_registered("""SELECT CAST(event_id AS VARCHAR) AS id, replace(props, ' ', '') AS body FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90""")
def project_whole_body(spark, sf_dir):
    docs = source.variants(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props"), "event_id", "props")
    r = query.normalize({"selector": {"/k": {"$gte": 90}}})
    return query.project(docs, query.select(docs, r), r).select("id", F.to_json("body").alias("body"))


@_registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE o_orderkey = 33")
def point_read(spark, sf_dir):
    docs = _docs(spark, sf_dir, "orders")
    row = query.get_one(docs, "33")
    return spark.createDataFrame([(str(row.o_orderkey), row.o_totalprice)], "id string, o_totalprice double")


@_registered("""
SELECT CAST(event_id AS VARCHAR) AS id, props FROM events
WHERE json_exists(props, '$.k') AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
  AND CAST(json_extract(props, '$.k') AS DOUBLE) = floor(CAST(json_extract(props, '$.k') AS DOUBLE))
  AND CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 3""")
def sel_json_mod_type(spark, sf_dir):
    docs = _docs(spark, sf_dir, "events", json=("props",))
    return _where(docs, {"/props/k": {"$exists": True, "$type": "number", "$mod": [7, 3]}}, "props")


def _holed(spark, sf_dir) -> Documents:
    docs = _docs(spark, sf_dir, "orders")
    docs.df = docs.df.withColumn("prio", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return docs


@_registered("""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prio FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS id, prio FROM o WHERE NOT coalesce(prio = '5-LOW', false) AND NOT (coalesce(prio <> '1-URGENT', false) AND o_totalprice < 50000)""")
def sel_not_missing(spark, sf_dir):
    selector = {"$not": {"/prio": "5-LOW"}, "$nor": [{"/prio": {"$ne": "1-URGENT"}, "/o_totalprice": {"$lt": 50000}}]}
    return _where(_holed(spark, sf_dir), selector, "prio")


@_registered("""
WITH a AS (SELECT l_orderkey, list(l_returnflag) AS flags, max(CASE WHEN l_quantity >= 45 AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS hit FROM lineitem GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(len(flags) AS INTEGER) AS n FROM a WHERE list_has_all(flags, ['N', 'A']) OR len(flags) = 2 OR hit = 1""")
def sel_array_all_size_elem(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"), F.collect_list(F.struct("l_quantity", "l_linestatus")).alias("lines"))
    selector = {"$or": [{"/flags": {"$all": ["N", "A"]}}, {"/flags": {"$size": 2}}, {"/lines": {"$elemMatch": {"/l_quantity": {"$gte": 45}, "/l_linestatus": "O"}}}]}
    return _where(Documents(rows, "l_orderkey"), selector, F.size("flags").alias("n"))


@_registered("""
SELECT t.name AS type_name, count(*) FILTER (WHERE t.name = CASE v.k % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN 'string' WHEN 4 THEN 'array' ELSE 'object' END) AS n,
       count(*) FILTER (WHERE v.k % 6 = 2 AND t.name = 'number' AND v.k > 50) AS above
FROM (SELECT event_id % 100 AS k FROM events) v, (VALUES ('null'), ('boolean'), ('number'), ('string'), ('array'), ('object')) t(name) GROUP BY 1""")
def sel_type_matrix(spark, sf_dir):
    k = F.col("event_id") % 100
    value = (
        F.when(k % 6 == 0, F.lit("null")).when(k % 6 == 1, "true").when(k % 6 == 2, k.cast("string"))
        .when(k % 6 == 3, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).when(k % 6 == 4, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise('{"a": 1}')
    )
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.parse_json(F.concat(F.lit('{"v": '), value, F.lit("}"))).alias("body"))
    docs = Documents(df, "event_id", body="body")
    names = ["null", "boolean", "number", "string", "array", "object"]
    marks = [truth(parse({"/v": {"$type": t}}), docs).cast("long").alias(t) for t in names] + [truth(parse({"/v": {"$gt": 50}}), docs).cast("long").alias("gt")]
    sums = df.select(*marks).agg(*(F.sum(c).alias(c) for c in [*names, "gt"]))
    pairs = F.array(*(F.struct(F.lit(t).alias("type_name"), F.col(f"`{t}`").alias("n"), (F.col("gt") if t == "number" else F.lit(0).cast("long")).alias("above")) for t in names))
    return sums.select(F.inline(pairs))


@_registered("""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prio FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS id, prio, o_orderstatus FROM o ORDER BY prio DESC NULLS FIRST, o_orderstatus DESC, CAST(o_orderkey AS VARCHAR) LIMIT 500""")
def sort_missing_desc(spark, sf_dir):
    sort = [{"path": "/prio", "direction": "desc"}, {"path": "/o_orderstatus", "direction": "desc"}]
    return _page(_holed(spark, sf_dir), {"sort": sort, "limit": 500}, ["/prio", "/o_orderstatus"])


@_registered("""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prio FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS id, prio, o_totalprice FROM o ORDER BY prio ASC NULLS LAST, o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 500""")
def sort_missing_asc_multi(spark, sf_dir):
    return _page(_holed(spark, sf_dir), {"sort": ["/prio", {"path": "/o_totalprice", "direction": "desc"}], "limit": 500}, ["/prio", "/o_totalprice"])


@_registered("""
WITH s AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT CAST(event_id AS VARCHAR) AS id, k FROM s WHERE k IS NOT NULL ORDER BY k DESC, CAST(event_id AS VARCHAR) LIMIT 100""")
def sort_json_key(spark, sf_dir):
    docs = _docs(spark, sf_dir, "events", json=("props",))
    df = query.page(docs, {"selector": {"/props/k": {"$exists": True}}, "sort": [{"path": "/props/k", "direction": "desc"}], "limit": 100})
    return df.select(docs.id_column().alias("id"), docs.at(("props", "k")).number().alias("k"))


@_registered("""
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT * FROM (SELECT id, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, id) AS n FROM l) WHERE n = 100)
SELECT l.id, l.l_extendedprice FROM l, c WHERE l.l_extendedprice < c.l_extendedprice OR (l.l_extendedprice = c.l_extendedprice AND l.id > c.id)
ORDER BY l.l_extendedprice DESC, l.id LIMIT 100""")
def page_keyset(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    docs = Documents(df, "id")
    request = {"selector": {"/l_returnflag": "R"}, "sort": [{"path": "/l_extendedprice", "direction": "desc"}], "fields": ["/l_extendedprice"], "limit": 100}
    first = query.execute(docs, request)
    return _page(docs, request | {"bookmark": first["bookmark"]}, ["/l_extendedprice"])


@_registered("""
SELECT CAST(c_custkey AS VARCHAR) AS id, to_json(c_name) AS name, CAST(c_nationkey AS VARCHAR) AS nation, CAST(NULL AS VARCHAR) AS absent, CAST(2 AS INTEGER) AS fields FROM customer WHERE c_nationkey < 5""")
def project_fields(spark, sf_dir):
    docs = _docs(spark, sf_dir, "customer")
    r = query.normalize({"selector": {"/c_nationkey": {"$lt": 5}}, "fields": ["/c_name", "/c_nationkey", "/nothing"]})
    df = query.project(docs, query.select(docs, r), r)
    get = lambda k: F.try_element_at("fields", F.lit(k))
    return df.select("id", get("/c_name").alias("name"), get("/c_nationkey").alias("nation"), get("/nothing").alias("absent"), F.size("fields").alias("fields"))


@_registered("""
SELECT a.position, a.asked, o.o_totalprice, o.o_orderkey IS NOT NULL AS found
FROM (VALUES (0, '7'), (1, 'none'), (2, '33'), (3, '7')) a(position, asked) LEFT JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = a.asked""")
def bulk_get(spark, sf_dir):
    return query.get(_docs(spark, sf_dir, "orders"), ["7", "none", "33", "7"]).select("position", "asked", "o_totalprice", "found")


@_registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '5' ORDER BY 1 LIMIT 300")
def scan_page(spark, sf_dir):
    docs = _docs(spark, sf_dir, "orders")
    return query.scan_page(docs, "5", 300).select(docs.id_column().alias("id"), "o_totalprice")


# Views


def _view(name: str, key: list[str], value: str | None, reducer: str | None, selector: dict[str, Any] | None = None) -> views.View:
    return views.define({"name": name, "selector": selector or {}, "key": [{"path": k} for k in key], "value": {"path": value} if value else None, "reducer": reducer})


def _lines(spark, sf_dir) -> Documents:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return Documents(df, "id")


@_registered("SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
def view_count_by_key(spark, sf_dir):
    df = views.query(_docs(spark, sf_dir, "orders"), _view("n", ["/o_orderpriority"], None, "_count"))
    return df.select(views.key_value("key0").alias("k"), F.col("count").alias("n"))


@_registered("SELECT l_returnflag AS k, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def view_sum_by_key(spark, sf_dir):
    df = views.query(_lines(spark, sf_dir), _view("s", ["/l_returnflag"], "/l_extendedprice", "_sum"))
    return df.select(views.key_value("key0").alias("k"), F.round("sum", 2).alias("total"))


@_registered("SELECT l_linestatus AS k, min(l_extendedprice) AS least, max(l_discount) AS most FROM lineitem GROUP BY 1")
def view_min_max_by_key(spark, sf_dir):
    docs = _lines(spark, sf_dir)
    low = views.query(docs, _view("lo", ["/l_linestatus"], "/l_extendedprice", "_min"))
    high = views.query(docs, _view("hi", ["/l_linestatus"], "/l_discount", "_max"))
    return low.join(high, "key0").select(views.key_value("key0").alias("k"), F.col("min").alias("least"), F.col("max").alias("most"))


@_registered("""
SELECT event_type AS k, count(value) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most, round(sum(value * value), 1) AS squares FROM events GROUP BY 1""")
def view_stats_by_key(spark, sf_dir):
    df = views.query(_docs(spark, sf_dir, "events"), _view("st", ["/event_type"], "/value", "_stats"))
    return df.select(views.key_value("key0").alias("k"), F.col("count").alias("n"), F.round("sum", 2).alias("total"), F.col("min").alias("least"), F.col("max").alias("most"), F.round("sumsqr", 1).alias("squares"))


@_registered("SELECT event_type AS k, round(sum(value), 2) AS total, count(value) AS n FROM events GROUP BY 1")
def view_exact_sum(spark, sf_dir):
    df = views.query(_docs(spark, sf_dir, "events"), _view("x", ["/event_type"], "/value", "_stats"), {"exact": True})
    return df.select(views.key_value("key0").alias("k"), F.round("sum", 2).alias("total"), F.col("count").alias("n"))


def _level(spark, sf_dir, level: int) -> DataFrame:
    df = views.query(_lines(spark, sf_dir), _view("lv", ["/l_returnflag", "/l_linestatus"], "/l_quantity", "_sum"), {"group_level": level})
    return df.select(*(views.key_value(f"key{n}").alias(f"k{n}") for n in range(level)), F.round("sum", 2).alias("total"))


@_registered("SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
def view_group_level_0(spark, sf_dir):
    return _level(spark, sf_dir, 0)


@_registered("SELECT l_returnflag AS k0, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def view_group_level_1(spark, sf_dir):
    return _level(spark, sf_dir, 1)


@_registered("SELECT l_returnflag AS k0, l_linestatus AS k1, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2")
def view_group_level_2(spark, sf_dir):
    return _level(spark, sf_dir, 2)


@_registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS k0, o_custkey AS k1, o_totalprice AS num FROM orders
WHERE o_orderstatus = 'O' AND (o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_custkey >= 500)) AND o_orderpriority < '4-NOT SPECIFIED'""")
def view_map_range(spark, sf_dir):
    view = _view("m", ["/o_orderpriority", "/o_custkey"], "/o_totalprice", None, {"/o_orderstatus": "O"})
    df = views.query(_docs(spark, sf_dir, "orders"), view, {"start_key": ["2-HIGH", 500], "end_key": ["4-NOT SPECIFIED"]})
    return df.select("id", F.col("key0.str").alias("k0"), F.col("key1.num").cast("bigint").alias("k1"), "num")


@_registered("""
SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS k, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') GROUP BY 1""")
def view_json_key(spark, sf_dir):
    df = views.query(_docs(spark, sf_dir, "events", json=("props",)), _view("j", ["/props/k"], None, "_count", {"/props/k": {"$type": "number"}}))
    return df.select(F.col("key0.num").alias("k"), F.col("count").alias("n"))


@_registered("""
SELECT event_type AS k, CAST(sum(CASE event_id % 4 WHEN 0 THEN CAST(10000000000000000 AS HUGEINT) WHEN 1 THEN 1 WHEN 2 THEN -10000000000000000 ELSE 3 END) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1""")
def view_exact_cancelling(spark, sf_dir):
    """Sums in which large numbers cancel, and a plain sum of binary64 loses the small ones."""
    x = F.col("event_id") % 4
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("x", F.when(x == 0, 1e16).when(x == 1, 1.0).when(x == 2, -1e16).otherwise(3.0))
    df = views.query(Documents(df, "event_id"), _view("x", ["/event_type"], "/x", "_stats"))
    return df.select(views.key_value("key0").alias("k"), F.col("sum").alias("total"), F.col("count").alias("n"))


@_registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS k0, o_totalprice AS num FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY k0, id LIMIT 80 OFFSET 80""")
def view_second_page(spark, sf_dir):
    """The second page of a view's rows, after the bookmark of the first."""
    docs, view = _docs(spark, sf_dir, "orders"), _view("p", ["/o_orderstatus"], "/o_totalprice", None, {"/o_orderpriority": "1-URGENT"})
    first = views.execute(docs, view, {"limit": 80, "consistency": "consistent"})
    return views.query(docs, view, {"limit": 80, "bookmark": first["bookmark"]}).select("id", F.col("key0.str").alias("k0"), "num")


# Federation


def _people(spark, sf_dir) -> dict[str, Documents]:
    a = Documents(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")), "c_custkey")
    b = Documents(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), "s_suppkey")
    return {"a": a, "b": b}


_PEOPLE = """
WITH u AS (SELECT 'a' AS source, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS bal FROM customer
           UNION ALL SELECT 'b', CAST(s_suppkey AS VARCHAR), s_name, s_acctbal FROM supplier),
s AS (SELECT *, row_number() OVER (ORDER BY bal DESC, source, id) AS n FROM u WHERE bal > 1000)
SELECT source, id, to_json(name) AS name, bal FROM s WHERE n {}"""
_FED = {"selector": {"/bal": {"$gt": 1000}}, "sort": [{"path": "/bal", "direction": "desc"}], "fields": ["/name"], "limit": 60}


def _fed(df: DataFrame) -> DataFrame:
    return df.select(F.col(federation.SOURCE).alias("source"), "id", F.col("fields")["/name"].alias("name"), F.col("k0").alias("bal"))


@_registered(_PEOPLE.format("<= 60"))
def fed_union_sorted(spark, sf_dir):
    return _fed(federation.page(_people(spark, sf_dir), _FED))


@_registered(_PEOPLE.format("BETWEEN 61 AND 120"))
def fed_second_page(spark, sf_dir):
    people = _people(spark, sf_dir)
    saved = federation.SavedQueries()
    saved.save("rich", people, _FED)
    first = saved.execute("rich", limit=60)
    return _fed(federation.page(people, _FED | {"bookmark": first["bookmark"]}))


# Full text

_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _fts(spark, sf_dir, text: str, mode: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "documents")
    s = search.normalize({"query": text, "fields": ["/text"], "mode": mode})
    return search.ranked(docs, s).select(docs.id_column().alias("id"))


@_registered(f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_all({_TOKENS}, ['that', 'with'])")
def fts_all(spark, sf_dir):
    return _fts(spark, sf_dir, "That, WITH", "all")


@_registered(f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_any({_TOKENS}, ['avec', 'und'])")
def fts_any(spark, sf_dir):
    return _fts(spark, sf_dir, "avec und", "any")


@_registered(f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ')")
def fts_phrase(spark, sf_dir):
    return _fts(spark, sf_dir, "of the", "phrase")


@_registered(f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE len(list_filter({_TOKENS}, lambda x: starts_with(x, 'licens'))) > 0")
def fts_prefix(spark, sf_dir):
    return _fts(spark, sf_dir, "licens", "prefix")


@_registered(f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_all({_TOKENS}, ['with', 'this']) AND lang = 'en' AND n_chars > 500")
def fts_selector(spark, sf_dir):
    docs = _docs(spark, sf_dir, "documents")
    r = query.normalize({"selector": {"/lang": "en", "/n_chars": {"$gt": 500}}, "search": {"query": "with this", "fields": ["/text"]}})
    return query.select(docs, r).select(docs.id_column().alias("id"))


@_registered(f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS tok FROM documents),
w AS (SELECT doc_id, CAST(len(tok) AS DOUBLE) AS len, CAST(len(list_filter(tok, lambda x: x = 'license')) AS DOUBLE) AS t1, CAST(len(list_filter(tok, lambda x: x = 'under')) AS DOUBLE) AS t2 FROM t),
s AS (SELECT count(*) AS n, avg(len) AS avg, sum(CASE WHEN t1 > 0 THEN 1 ELSE 0 END) AS d1, sum(CASE WHEN t2 > 0 THEN 1 ELSE 0 END) AS d2 FROM w),
r AS (SELECT doc_id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / avg))
             + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * len / avg)) AS score FROM w, s WHERE t1 > 0 OR t2 > 0)
SELECT CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM r ORDER BY round(score, 9) DESC, CAST(doc_id AS VARCHAR) LIMIT 50""")
def fts_bm25_topk(spark, sf_dir):
    docs = _docs(spark, sf_dir, "documents")
    hits = search.ranked(docs, search.normalize({"query": "license under", "fields": ["/text"], "mode": "any"}))
    return hits.orderBy(F.round("rank", 9), docs.id_column()).limit(50).select(docs.id_column().alias("id"), F.round(-F.col("rank"), 6).alias("score"))


@_registered(f"""
SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY 1""")
def fts_postings(spark, sf_dir):
    index = search.postings(_docs(spark, sf_dir, "documents"), (("text",),), positions=False)
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_registered(f"""
WITH t AS (SELECT doc_id, len(list_filter({_TOKENS}, lambda x: x = 'license')) AS tf FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY tf DESC, doc_id) AS rank FROM t WHERE tf > 0),
j AS (SELECT l.doc_id, l.quality AS grade FROM labels l),
h AS (SELECT rank, grade, row_number() OVER (ORDER BY rank) AS nth FROM r JOIN j USING (doc_id) WHERE grade > 0 AND rank <= 20),
i AS (SELECT sum(1 / log2(place + 1)) AS idcg FROM (SELECT row_number() OVER () AS place FROM j WHERE grade > 0 LIMIT 20)),
n AS (SELECT count(*) AS relevant FROM j WHERE grade > 0)
SELECT 1 AS query_id, round(coalesce((SELECT sum((pow(2, grade) - 1) / log2(rank + 1)) FROM h), 0) / (SELECT idcg FROM i), 6) AS ndcg,
       round((SELECT count(*) FROM h) / (SELECT CAST(relevant AS DOUBLE) FROM n), 6) AS recall,
       round(coalesce((SELECT sum(CAST(nth AS DOUBLE) / rank) FROM h), 0) / (SELECT relevant FROM n), 6) AS average_precision""")
def ir_ndcg_recall_map(spark, sf_dir):
    docs = _docs(spark, sf_dir, "documents")
    tf = F.size(F.filter(search.tokenize(F.col("text")), lambda t: t == "license"))
    hits = docs.df.select(F.lit(1).alias("query_id"), "doc_id", tf.alias("tf")).where("tf > 0")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tf"), "doc_id")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.lit(1).alias("query_id"), "doc_id", F.col("quality").alias("grade"))
    df = metrics.retrieval(ranked, labels, 20)
    return df.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "average_precision")))


@_registered(ORACLE_SQL["fts_bm25_topk"])
def fts_index_ranked(spark, sf_dir):
    """The same from a stored index: rank from the postings of the query's words, and the selected documents by a join."""
    docs = _docs(spark, sf_dir, "documents")
    index = search.SearchIndex(spark, scratch(spark, "fts"), ["/text"])
    index.rebuild(docs)
    docs.extra["search_index"] = index
    hits = query.select(docs, query.normalize({"search": {"query": "license under", "fields": ["/text"], "mode": "any"}}))
    return hits.orderBy(F.round("rank", 9), docs.id_column()).limit(50).select(docs.id_column().alias("id"), F.round(-F.col("rank"), 6).alias("score"))


@_registered(f"SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ') AND n_chars > 300")
def fts_index_refreshed(spark, sf_dir):
    """A phrase and a selector through an index that was built from old texts and then refreshed."""
    docs = _docs(spark, sf_dir, "documents")
    old = Documents(docs.df.withColumn("text", F.when(F.col("doc_id") % 20 == 0, F.lit("of the old")).otherwise(F.col("text"))), "doc_id")
    index = search.SearchIndex(spark, scratch(spark, "fts"), ["/text"])
    index.rebuild(old, 1)
    index.refresh(Documents(docs.df.where("doc_id % 20 = 0"), "doc_id"), 2)
    docs.extra["search_index"] = index
    r = query.normalize({"selector": {"/n_chars": {"$gt": 300}}, "search": {"query": "of the", "fields": ["/text"], "mode": "phrase"}})
    return query.select(docs, r).select(docs.id_column().alias("id"), "lang")


@_registered("SELECT DISTINCT sha256(coalesce(text, '')) AS digest FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)")
def blobs_unreferenced(spark, sf_dir):
    """Contents that no manifest refers to any more."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    return source.unreferenced(rows.select("digest").distinct(), rows.where("doc_id % 3 = 0").select("digest"))


# Revisions: each user's events are revisions, two siblings a generation, children of the first

_REVISIONS = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
g AS (SELECT CAST(user_id AS VARCHAR) AS document_id, CAST(i // 2 + 1 AS VARCHAR) || '-' || sha256(CAST(event_id AS VARCHAR)) AS revision_id, i, user_id,
             event_id % 7 = 0 OR user_id % 10 = 3 AS deleted, event_id FROM n),
r AS (SELECT a.document_id, a.revision_id, p.revision_id AS parent_revision, a.deleted, a.i, a.event_id FROM g a LEFT JOIN g p ON p.user_id = a.user_id AND p.i % 2 = 0 AND p.i // 2 = a.i // 2 - 1),
leaf AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.document_id = r.document_id AND c.parent_revision = r.revision_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY deleted, CAST(split_part(revision_id, '-', 1) AS INTEGER) DESC, split_part(revision_id, '-', 2) DESC) AS k FROM leaf)
"""


def _revisions(spark, sf_dir) -> DataFrame:
    """One window: a revision's parent is the first of the generation before, two or three events back."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("document_id"))
    own = Window.partitionBy("document_id").orderBy("event_id")
    rows = rows.select("*", (F.row_number().over(own) - 1).alias("i"), F.lag("event_id", 2).over(own).alias("second"), F.lag("event_id", 3).over(own).alias("third"))
    name = lambda g, event: F.concat_ws("-", F.expr(g), F.sha2(event.cast("string"), 256))
    parent = F.when((F.col("i") >= 2) & F.col("document_id").isNotNull(), name("i div 2", F.when(F.col("i") % 2 == 0, F.col("second")).otherwise(F.col("third"))))
    return rows.select(
        "document_id", name("i div 2 + 1", F.col("event_id")).alias("revision_id"), parent.alias("parent_revision"), F.lit("h").alias("history_id"),
        ((F.col("event_id") % 7 == 0) | (F.col("document_id").cast("bigint") % 10 == 3)).alias("deleted"), "i", "event_id",
    )


@_registered(_REVISIONS + "SELECT document_id, revision_id FROM leaf")
def rev_leaves(spark, sf_dir):
    return revisions.leaves(_revisions(spark, sf_dir)).select("document_id", "revision_id")


@_registered(_REVISIONS + "SELECT document_id, revision_id, deleted FROM w WHERE k = 1")
def rev_winner(spark, sf_dir):
    return revisions.winners(_revisions(spark, sf_dir)).select("document_id", "revision_id", "deleted")


@_registered(_REVISIONS + "SELECT document_id, string_agg(revision_id, ',' ORDER BY revision_id) AS conflicts FROM w WHERE k > 1 AND NOT deleted GROUP BY 1")
def rev_conflicts(spark, sf_dir):
    return revisions.conflicts(_revisions(spark, sf_dir)).select("document_id", F.array_join("conflicts", ",").alias("conflicts"))


@_registered(_REVISIONS + "SELECT document_id, revision_id FROM leaf WHERE event_id % 3 = 0")
def rev_diff(spark, sf_dir):
    rows = _revisions(spark, sf_dir)
    return revisions.missing(revisions.leaves(rows), rows.where("event_id % 3 <> 0"))


@_registered(_REVISIONS + """, top AS (SELECT document_id, revision_id, deleted, i FROM w WHERE k = 1),
dead AS (SELECT document_id FROM leaf GROUP BY 1 HAVING bool_and(deleted)),
settled AS (SELECT document_id FROM r GROUP BY 1 HAVING max(event_id) <= (SELECT CAST(max(event_id) * 0.999 AS BIGINT) FROM events)),
keep AS (SELECT r.document_id, r.revision_id FROM r JOIN top t USING (document_id) WHERE r.revision_id = t.revision_id OR (r.i % 2 = 0 AND r.i // 2 < t.i // 2 AND r.i // 2 >= t.i // 2 - 2))
SELECT r.document_id, r.revision_id, CASE WHEN d.document_id IS NULL THEN 'superseded' ELSE 'retired' END AS reason
FROM r JOIN settled USING (document_id) LEFT JOIN dead d ON d.document_id = r.document_id
WHERE d.document_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM keep k WHERE k.document_id = r.document_id AND k.revision_id = r.revision_id)""")
def rev_compaction(spark, sf_dir):
    rows = _revisions(spark, sf_dir)
    latest = rows.select("document_id", F.col("event_id").alias("sequence"))
    floor = int(rows.agg(F.max("event_id")).first()[0] * 0.999)
    return revisions.compaction(rows, latest, floor, 2)


@_registered(_REVISIONS + """, f AS (SELECT document_id, revision_id, deleted, event_id, parent_revision AS was,
  CASE WHEN parent_revision IS NOT NULL AND event_id % 50 = 0 THEN split_part(parent_revision, '-', 1) || '-' || sha256('none') WHEN parent_revision IS NOT NULL AND event_id % 53 = 0 THEN '9' || parent_revision ELSE parent_revision END AS parent FROM r)
SELECT 'dangling_parent' AS rule, document_id, revision_id FROM f WHERE parent <> was
UNION ALL SELECT 'generation', document_id, revision_id FROM f WHERE parent <> was AND event_id % 50 <> 0
UNION ALL SELECT 'live_without_body', document_id, revision_id FROM f WHERE NOT deleted AND event_id % 77 = 0
UNION ALL SELECT 'deleted_body', document_id, revision_id FROM f WHERE deleted AND event_id % 77 <> 0""")
def rev_integrity(spark, sf_dir):
    """Every fault planted in the links and bodies of the whole table is found by its rule."""
    parent, whole = F.col("parent_revision"), F.col("event_id")
    wrong = F.concat_ws("-", F.substring_index(parent, "-", 1), F.sha2(F.lit("none"), 256))
    rows = _revisions(spark, sf_dir).withColumn("parent_revision", F.when(parent.isNotNull() & (whole % 50 == 0), wrong).when(parent.isNotNull() & (whole % 53 == 0), F.concat(F.lit("9"), parent)).otherwise(parent))
    return revisions.check(rows.withColumn("body", F.when(whole % 77 != 0, "{}")).drop("i", "event_id"))


@_registered(_REVISIONS + "SELECT document_id, revision_id, (SELECT max(event_id) FROM events) AS checkpoint FROM r")
def rev_replicate(spark, sf_dir):
    """The target after a pass: the source's revisions, each once, those it had among them, and parents it lacked."""
    rows = _revisions(spark, sf_dir)
    log = rows.select(F.col("event_id").alias("sequence"), "document_id")
    target, checkpoint = changes.replicate(rows, rows.where("event_id % 2 = 0 and i < 2"), log, 0)
    return target.select("document_id", "revision_id", F.lit(checkpoint).cast("bigint").alias("checkpoint"))


@_registered(_REVISIONS + "SELECT document_id, revision_id, parent_revision FROM r")
def rev_merge(spark, sf_dir):
    """The union of two sets that share revisions, again with itself: each revision once."""
    rows = _revisions(spark, sf_dir)
    ours, theirs = rows.where("i < 40"), rows.where("event_id % 3 <> 1 or i < 60 or i >= 60")
    return revisions.merge(revisions.merge(ours, theirs), theirs).select("document_id", "revision_id", "parent_revision")


@_registered(_REVISIONS + """, first AS (SELECT document_id, revision_id, event_id FROM r ORDER BY document_id, i LIMIT 1)
SELECT document_id, revision_id, event_id FROM first""")
def rev_point_read(spark, sf_dir):
    """A revision by its id, whether or not it won."""
    rows = _revisions(spark, sf_dir)
    first = rows.orderBy("document_id", "i").first()
    r = revisions.read(rows, first.document_id, first.revision_id)
    return spark.createDataFrame([(r.document_id, r.revision_id, r.event_id)], "document_id string, revision_id string, event_id long")


def _new(after: DataFrame, before: DataFrame) -> DataFrame:
    key = ["document_id", "revision_id"]
    return after.select(*key, "parent_revision", "deleted", "body").join(before.select(*key), key, "left_anti")


_ID = """'-' || sha256('{"attachments":{},"body":' || coalesce(body, 'null') || ',"deleted":' || deleted || ',"document_id":"' || document_id || '","history_id":"h","parent_revision":' || coalesce('"' || parent || '"', 'null') || ',"version":1}')"""


@_registered(_REVISIONS + f""", live AS (SELECT document_id, revision_id AS parent, deleted AS gone, row_number() OVER (ORDER BY document_id) AS n FROM w WHERE k = 1 AND NOT deleted),
made AS (SELECT document_id, parent, '{{"v":2}}' AS body, false AS deleted FROM live WHERE n <= 5 UNION ALL SELECT document_id, parent, NULL, true FROM live WHERE n = 6
         UNION ALL SELECT 'new-' || x, NULL, '{{"a":' || x || '}}', false FROM (VALUES (1), (2)) v(x))
SELECT document_id, coalesce(CAST(split_part(parent, '-', 1) AS INTEGER), 0) + 1 || {_ID} AS revision_id, parent AS parent_revision, deleted, body FROM made""")
def rev_write(spark, sf_dir):
    """A batch of updates, a delete, new documents and a replay: the revisions that it adds."""
    rows = durable(_revisions(spark, sf_dir).withColumn("body", F.lit('{"v":1}')))
    live = revisions.winners(rows).where("not deleted").orderBy("document_id").limit(6).collect()
    batch = [{"id": r.document_id, "if_revision": r.revision_id, "body": {"v": 2}} for r in live[:5]] + [{"id": live[5].document_id, "if_revision": live[5].revision_id, "delete": True}]
    batch += [{"id": "new-1", "history_id": "h", "body": {"a": 1}}, {"id": "new-2", "history_id": "h", "body": {"a": 2}}, {"id": "new-1", "history_id": "h", "body": {"a": 1}}]
    return _new(revisions.write(rows, batch)[0], rows)


@_registered(_REVISIONS + f""", torn AS (SELECT document_id FROM w WHERE NOT deleted GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 1),
made AS (SELECT document_id, revision_id AS parent, k > 1 AS deleted, CASE WHEN k = 1 THEN '{{"kept":true}}' END AS body FROM w JOIN torn USING (document_id) WHERE NOT w.deleted)
SELECT document_id, CAST(split_part(parent, '-', 1) AS INTEGER) + 1 || {_ID} AS revision_id, parent AS parent_revision, deleted, body FROM made""")
def rev_resolve(spark, sf_dir):
    """A conflict ended: a child of the leaf that is kept, tombstones of the others."""
    rows = durable(_revisions(spark, sf_dir).withColumn("body", F.lit('{"v":1}')))
    torn = revisions.conflicts(rows).orderBy("document_id").first()
    return _new(revisions.resolve(rows, torn.document_id, [torn.winner, *torn.conflicts], torn.winner, {"kept": True}), rows)


@_registered("""
WITH p AS (SELECT c_custkey, c_custkey * 10 AS safe, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS expires FROM customer WHERE c_custkey >= 7)
SELECT min(safe) FILTER (WHERE expires IS NULL OR expires > 100) AS candidate_floor, true AS floor_advanced, count(*) FILTER (WHERE expires IS NULL OR expires > 100) AS active_peers FROM p""")
def rev_frontier(spark, sf_dir):
    """Up to where history may go, by peers whose lease has not run out."""
    peers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey >= 7").select((F.col("c_custkey") * 10).alias("safe_sequence"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).alias("expires_ms"))
    got = revisions.frontier(peers, 10**6, 50, 100)
    return spark.createDataFrame([(got["candidate_floor"], got["floor_advanced"], got["active_peers"])], "candidate_floor long, floor_advanced boolean, active_peers long")


@_registered("""
SELECT 'attachment_fields' AS rule, doc_id || '/1-x' AS subject FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0
UNION ALL SELECT 'attachment_without_revision', doc_id || '/1-x' FROM documents WHERE doc_id % 13 = 0
UNION ALL SELECT 'peer_ahead', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey > 1000
UNION ALL SELECT 'peer_below_floor', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey < 10
UNION ALL SELECT 'peer_epoch', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 100 = 3
UNION ALL SELECT 'checkpoint_history', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 50 = 1
UNION ALL SELECT 'revision_below_boundary', doc_id || '/1-x' FROM documents WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0
UNION ALL SELECT 'metadata_database_uuid', NULL""")
def rev_integrity_records(spark, sf_dir):
    """Faults planted in the records beside revisions."""
    docs, people = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, name = F.col("doc_id"), F.col("doc_id").cast("string")
    files = docs.select(
        name.alias("document_id"), F.lit("1-x").alias("revision_id"), F.when(key % 7 == 0, "zz").otherwise(F.sha2(name, 256)).alias("digest"), F.when(key % 11 == 0, -1).otherwise(F.length(name)).cast("long").alias("length")
    )
    stored = docs.where("doc_id % 13 <> 0").select(name.alias("document_id"), F.lit("1-x").alias("revision_id"), F.lit(None).cast("string").alias("parent_revision"))
    kids = docs.where("doc_id % 13 <> 0").select(name.alias("document_id"), F.lit("2-x").alias("revision_id"), F.lit("1-x").alias("parent_revision"))
    bounds = docs.where("doc_id % 17 = 0").select(name.alias("document_id"), F.lit(2).alias("minimum_generation"), F.lit(1).alias("compaction_epoch"))
    c = F.col("c_custkey")
    peers = people.select(
        c.cast("string").alias("peer_id"), F.lit("d").alias("database_uuid"), F.when(c % 100 == 3, "old").otherwise("e").alias("history_epoch"), c.alias("safe_sequence"), F.lit(1).alias("compaction_epoch"), F.lit(None).cast("long").alias("expires_ms")
    )
    points = people.select(c.cast("string").alias("peer_id"), F.lit(5).alias("safe_sequence"), F.lit(1).alias("compaction_epoch"), F.when(c % 50 == 1, F.array(F.lit(3), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(5))).alias("history"))
    found = integrity.check(spark, {"database_uuid": "", "history_epoch": "e", "sequence": 1000, "floor": 10, "compaction_epoch": 1}, stored.union(kids), bounds, peers, points, files)
    # The peers' database is not the one that has no name.
    return found.where("rule <> 'peer_database'")


# Changes, subscriptions


@_registered("SELECT event_id AS sequence, CAST(user_id AS VARCHAR) AS document_id FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 100")
def chg_since(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("document_id"))
    return changes.since(log, 200, 100)


@_registered("SELECT CAST(user_id AS VARCHAR) AS document_id, max(event_id) AS sequence, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def chg_latest(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("document_id"), "event_type")
    return changes.latest(log)


@_registered(_REVISIONS + "SELECT event_id AS sequence, r.document_id, revision_id AS winning_revision, CASE WHEN event_id % 5 <> 0 THEN '{\"e\":' || event_id || '}' END AS body FROM r")
def chg_with_bodies(spark, sf_dir):
    """Changes with the bodies of their revisions; where the revision is gone, without."""
    rows = _revisions(spark, sf_dir).withColumn("body", F.concat(F.lit('{"e":'), F.col("event_id"), F.lit("}")))
    log = rows.select(F.col("event_id").alias("sequence"), "document_id", F.col("revision_id").alias("winning_revision"))
    return changes.with_bodies(log, rows.where("event_id % 5 <> 0")).select("sequence", "document_id", "winning_revision", "body")


@_registered("SELECT 'history_truncated' AS below, count(*) AS kept FROM events WHERE event_id > 400")
def chg_floor(spark, sf_dir):
    """Below the floor the feed is refused, above it read."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("sequence"))
    try:
        changes.since(log, 100, floor=400)
        code = "none"
    except EngineError as e:
        code = e.code
    return changes.since(log, 400, floor=400).agg(F.lit(code).alias("below"), F.count("*").alias("kept"))


@_registered("SELECT CAST(c_custkey AS VARCHAR) AS id, 'snapshot' AS event_type, to_json(c_name) AS name FROM customer WHERE c_nationkey < 3 AND c_acctbal > 5000")
def sub_snapshot(spark, sf_dir):
    request = {"selector": {"/c_nationkey": {"$lt": 3}, "/c_acctbal": {"$gt": 5000}}, "fields": ["/c_name"]}
    out = subscription.snapshot(_docs(spark, sf_dir, "customer"), request, members=None)
    return out.select("id", "event_type", F.col("fields")["/c_name"].alias("name"))


@_registered("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS last FROM events GROUP BY 1)
SELECT 0 AS place, 'reset' AS event_type, CAST(200 AS BIGINT) AS sequence, '-' AS id
UNION ALL SELECT 1, 'snapshot', -1, CAST(user_id AS VARCHAR) FROM l WHERE kind = 'error'
UNION ALL SELECT 2, 'caught_up', (SELECT max(event_id) FROM events), '-'""")
def sub_reset(spark, sf_dir):
    """A subscriber whose place in the feed is gone: a reset, the members anew, and that it has caught up."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id")
    now = log.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))
    sent = subscription.events(Documents(now, "user_id"), Documents(log, "user_id"), {"selector": {"/event_type": "error"}}, 100, "event_id", floor=200, most=None)
    return sent.select("place", "event_type", F.coalesce("sequence", F.lit(-1)).alias("sequence"), F.coalesce("id", F.lit("-")).alias("id"))


@_registered("""
WITH m AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS sequence, event_type <> 'view' AND value >= 20 AS now FROM events),
t AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY id ORDER BY sequence), false) AS was FROM m)
SELECT CASE WHEN now THEN 'upsert' ELSE 'remove' END AS event_type, sequence, id FROM t WHERE now OR was""")
def sub_transitions(spark, sf_dir):
    docs = Documents(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id")
    return subscription.transitions(docs, {"/event_type": {"$ne": "view"}, "/value": {"$gte": 20}}, "event_id")


@_registered("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT kind AS k, count(*) AS n, round(sum(value), 2) AS total FROM l GROUP BY 1""")
def mv_reduce_incremental(spark, sf_dir):
    """A materialized view: most documents at once, then small batches as layers over them; the last change of a
    document replaces its contribution."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    view = MaterializedView(spark, scratch(spark, "mv"), {"name": "mv", "key": [{"path": "/event_type"}], "value": {"path": "/value"}, "reducer": "_stats"}, group_level=1)
    last = df.agg(F.max("event_id")).first()[0] + 1
    for k, (start, end) in enumerate([(0, 0.96), (0.96, 0.98), (0.98, 1)], 1):
        batch = df.where((F.col("event_id") >= int(last * start)) & (F.col("event_id") < (int(last * end) if end < 1 else last)))
        view.apply(Documents(batch, "user_id"), k, sequence="event_id", expected=k - 1)
    get = lambda path, kind: F.get_json_object("body", path).cast(kind)
    return view.documents().select(get("$.key[0]", "string").alias("k"), get("$.value.count", "bigint").alias("n"), F.round(get("$.value.sum", "double"), 2).alias("total"))


@_registered("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT 'g-' || sha256('["' || kind || '"]') AS id, kind AS k, count(*) AS n, min(value) AS least, max(value) AS most FROM l GROUP BY kind""")
def mv_materialized(spark, sf_dir):
    """A materialized view that three batches of changes have been applied to, as generated documents."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    definition = {"name": "mv", "key": [{"path": "/event_type"}], "value": {"path": "/value"}, "reducer": "_stats"}
    view = MaterializedView(spark, scratch(spark, "mv"), definition, group_level=1)
    last = df.agg(F.max("event_id")).first()[0] + 1
    for k in range(1, 4):
        batch = df.where((F.col("event_id") >= last * (k - 1) / 3) & (F.col("event_id") < last * k / 3))
        view.apply(Documents(batch, "user_id"), k, sequence="event_id", expected=k - 1)
    get = lambda path, kind: F.get_json_object("body", path).cast(kind)
    return view.documents().select("id", get("$.key[0]", "string").alias("k"), get("$.value.count", "bigint").alias("n"), get("$.value.min", "double").alias("least"), get("$.value.max", "double").alias("most"))


@_registered("""
SELECT 'm-' || sha256('["orders","' || CAST(o_orderkey AS VARCHAR) || '"]') AS id, o_orderpriority AS k, CAST(o_orderkey AS VARCHAR) AS document, o_custkey AS value FROM orders WHERE o_orderstatus = 'P'""")
def mv_map_documents(spark, sf_dir):
    """A map-only materialized view after a rebuild: one generated document for each that matches."""
    definition = {"name": "m", "selector": {"/o_orderstatus": "P"}, "key": [{"path": "/o_orderpriority"}], "value": {"path": "/o_custkey"}}
    view = MaterializedView(spark, scratch(spark, "mv"), definition, source="orders")
    view.rebuild(_docs(spark, sf_dir, "orders"), 1)
    get = lambda path: F.get_json_object("body", path)
    return view.documents().select("id", get("$.key[0]").alias("k"), get("$.source_document_id").alias("document"), get("$.value").cast("bigint").alias("value"))


@_registered("""
WITH m AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS sequence, CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 AS now FROM events),
t AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY id ORDER BY sequence), false) AS was FROM m)
SELECT CASE WHEN now THEN 'upsert' ELSE 'remove' END AS event_type, sequence, id FROM t WHERE now OR was""")
def sub_stream(spark, sf_dir):
    """The change table as a stream, each document's membership as state, until it has caught up."""
    at = scratch(spark, "sub")
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df.select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("id"), F.lit("r").alias("revision"), F.lit(False).alias("deleted"), F.col("props").alias("body")).write.parquet(at + "/log")
    schema = "sequence long, id string, revision string, deleted boolean, body string"
    key, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    held = spark.conf.get(key)
    spark.conf.set(key, wanted)
    try:
        events = subscription.stateful(subscription.follow(spark, at + "/log", schema, 100), {"/k": {"$gte": 50}})
        subscription.publish(events, at + "/out", at + "/checkpoint").awaitTermination()
    finally:
        spark.conf.set(key, held)
    return spark.read.schema(subscription.EVENTS).json(at + "/out").select("event_type", "sequence", "id")


@_registered(f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' licensed under the ')")
def fts_index_phrase(spark, sf_dir):
    """A phrase found in a stored index of positions."""
    index = search.SearchIndex(spark, scratch(spark, "fts"), ["/text"])
    index.rebuild(_docs(spark, sf_dir, "documents"))
    return index.search("licensed under the", "phrase")


@_registered("""
SELECT CAST(event_id AS VARCHAR) AS id, '1-' || sha256('{"attachments":{},"body":' || replace(props, ' ', '') || ',"deleted":false,"document_id":"' || CAST(event_id AS VARCHAR)
       || '","history_id":"h","parent_revision":null,"version":1}') AS revision_id FROM events""")
def rev_identify(spark, sf_dir):
    """Revision ids of documents that are written first."""
    none = F.lit(None).cast("string")
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("document_id"), F.lit("h").alias("history_id"), none.alias("parent_revision"), F.lit(False).alias("deleted"), F.col("props").alias("body"), none.alias("attachments")
    )
    return revisions.identify(df).select(F.col("document_id").alias("id"), "revision_id")


@_registered(_REVISIONS.replace("WITH n AS", "WITH RECURSIVE n AS", 1) + """, walk AS (SELECT document_id, revision_id AS leaf, revision_id, parent_revision, 0 AS depth FROM w WHERE k = 1
  UNION ALL SELECT r.document_id, a.leaf, r.revision_id, r.parent_revision, a.depth + 1 FROM walk a JOIN r ON r.document_id = a.document_id AND r.revision_id = a.parent_revision)
SELECT document_id, leaf, revision_id, depth FROM walk""")
def rev_chains(spark, sf_dir):
    """Every winner's chain to its root."""
    rows = _revisions(spark, sf_dir)
    return revisions.chains(rows, revisions.winners(rows).select("document_id", "revision_id")).select("document_id", "leaf", "revision_id", "depth")


@_registered("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 250000)) AS neither, count(*) AS every FROM orders")
def sel_truth(spark, sf_dir):
    """A selector's truth as a column."""
    docs = _docs(spark, sf_dir, "orders")
    marks = {"finished": {"/o_orderstatus": "F"}, "neither": {"$nor": [{"/o_orderstatus": "F"}, {"/o_totalprice": {"$gt": 250000}}]}, "every": {}}
    return docs.df.agg(*(F.sum(truth(parse(s), docs).cast("long")).alias(n) for n, s in marks.items()))


@_registered("""
SELECT name, n FROM (SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'part', count(*) FROM part WHERE p_size = 1 OR p_size = 50)""")
def or_union_dedup(spark, sf_dir):
    """OR as a union of its branches without doubles, as one disjunctive filter."""
    counts = [
        _where(_docs(spark, sf_dir, "orders"), {"$or": [{"/o_totalprice": {"$gt": 400000}}, {"/o_totalprice": {"$gt": 450000}}]}).agg(F.lit("orders").alias("name"), F.count("*").alias("n")),
        _where(_docs(spark, sf_dir, "part"), {"$or": [{"/p_size": 1}, {"/p_size": {"$in": [1, 50]}}]}).agg(F.lit("part").alias("name"), F.count("*").alias("n")),
    ]
    return reduce(DataFrame.union, counts)


def _codes(spark: SparkSession, cases: dict[str, Callable[[], Any]]) -> DataFrame:
    """name and code of what each case raises."""
    found = []
    for name, case in cases.items():
        try:
            case()
            found.append((name, "none"))
        except EngineError as e:
            found.append((name, e.code))
    return spark.createDataFrame(found, "name string, code string")


@_registered("""
SELECT * FROM (VALUES ('operand', 'invalid_request'), ('depth', 'invalid_request'), ('regex_flags', 'invalid_request'), ('branches', 'invalid_request'), ('limit', 'invalid_request'), ('unknown_field', 'invalid_request'),
  ('no_token', 'invalid_request'), ('rank_and_sort', 'invalid_request'), ('scan', 'index_required'), ('hint', 'invalid_index_hint'), ('candidates', 'resource_limit'), ('other_query', 'invalid_bookmark'), ('stale', 'bookmark_stale'),
  ('broken', 'invalid_bookmark'), ('fine', 'none')) v(name, code)""")
def request_errors(spark, sf_dir):
    """Requests that are refused, and by which code."""
    docs, texts = _docs(spark, sf_dir, "nation"), _docs(spark, sf_dir, "documents")
    deep: dict[str, Any] = {"/x": 1}
    for _ in range(40):
        deep = {"$not": deep}
    ask = lambda **request: lambda: query.execute(docs, request)
    find = lambda text, **more: lambda: query.execute(texts, {"search": {"query": text, "fields": ["/text"]} | more})
    mark = query.execute(docs, {"limit": 3})["bookmark"]
    changed = Documents(docs.df, docs.id, version="another")
    return _codes(spark, {
        "operand": ask(selector={"/x": {"$gt": None}}), "depth": ask(selector=deep), "regex_flags": ask(selector={"/x": {"$regex": "(?i)a"}}), "branches": ask(selector={"$or": []}), "limit": ask(limit=501), "unknown_field": ask(what=1),
        "no_token": find(" ,"), "rank_and_sort": lambda: query.execute(texts, {"search": {"query": "a", "fields": ["/text"]}, "sort": ["/lang"]}), "scan": ask(scan_threshold=5), "hint": ask(index="none"), "candidates": find("the", max_candidates=3),
        "other_query": ask(limit=3, bookmark=mark, sort=["/n_name"]), "stale": lambda: query.execute(changed, {"limit": 3, "bookmark": mark}), "broken": ask(bookmark="???"), "fine": ask(limit=3, bookmark=mark),
    })


@_registered("""
SELECT * FROM (VALUES ('equal and range', 'single', 'pier_state_length'), ('hint', 'single', 'pier'), ('two branches', 'union', 'pier,state'), ('a branch without', 'bounded_scan', ''), ('not equal', 'bounded_scan', ''), ('text', 'full_text', 'words')) v(name, plan_kind, indexes)""")
def plan_choices(spark, sf_dir):
    """Which indexes a plan names for a selector."""
    catalog = views.Catalog()
    for name, fields in (("pier", ["/pier"]), ("state", ["/state"]), ("pier_state_length", ["/pier", "/state", "/length"])):
        catalog.create_index({"name": name, "type": "structured", "fields": fields})
    catalog.create_index({"name": "words", "type": "full_text", "fields": ["/boat"]})
    docs = Documents(spark.createDataFrame([], "id string, pier string, state string, length double, boat string"), "id")
    asked = {
        "equal and range": {"selector": {"/pier": "a", "/state": "b", "/length": {"$gt": 1}}}, "hint": {"selector": {"/pier": "a"}, "index": "pier"}, "two branches": {"selector": {"$or": [{"/pier": "a"}, {"/state": "b"}]}},
        "a branch without": {"selector": {"$or": [{"/pier": "a"}, {"/boat": "b"}]}}, "not equal": {"selector": {"/pier": {"$ne": "a"}}}, "text": {"search": {"query": "heron", "fields": ["/boat"]}},
    }
    plans = {n: query.plan(docs, r, catalog.list_indexes()) for n, r in asked.items()}
    return spark.createDataFrame([(n, p["plan_kind"], ",".join(p["selected_indexes"])) for n, p in plans.items()], "name string, plan_kind string, indexes string")


@_registered("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_nationkey = 7")
def json_lines_selected(spark, sf_dir):
    """Documents written as JSON lines and read again, as bodies, by a selector."""
    at = scratch(spark, "json")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("id", F.col("c_custkey").cast("string"))
    source.write_json(Documents(customers, "id"), at + "/lines")
    docs = source.json_lines(spark, at + "/lines")
    rows = docs.df.where(condition(parse({"/c_nationkey": 7}), docs))
    return rows.select("id", docs.at(("c_name",)).string().alias("c_name"), docs.at(("c_nationkey",)).number().cast("bigint").alias("nation"))
