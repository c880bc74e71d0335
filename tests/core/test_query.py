"""Pages, order, projection, bookmarks, explain."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.errors import EngineError
from tessella.operators import query
from tessella.operators.views import Catalog
from tessella.plans.binding import Documents

#: A harbour's berths: some fields null, some not there, some of another type.
BODIES = {
    "b1": {"pier": "north", "state": "taken", "length": 12, "boat": "Wavedancer", "moored": [{"rope": "bow", "m": 4}, {"rope": "stern", "m": 5}]},
    "b2": {"pier": "north", "state": "free", "length": 30, "boat": "Grey Heron"},
    "b3": {"pier": "south", "state": None, "length": 7.5, "owner": {"name": "Okafor"}},
    "b4": {"pier": "south", "length": 18, "boat": "Heron Two", "moored": ["bow", {"rope": "spring"}]},
    "b5": {"pier": "dry", "state": "taken", "length": "18", "flags": {"$note": "x"}},
    "b6": {"pier": "dry", "state": "closed"},
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(k, "1-x", json.dumps(v)) for k, v in BODIES.items()], "id string, revision string, text string")
    return Documents(df.select("id", "revision", F.parse_json("text").alias("body")), "id", body="body", revision="revision", version="7")


def ids(docs, **request):
    return [r["id"] for r in query.execute(docs, request)["results"]]


def test_selection(docs):
    assert ids(docs, selector={"/pier": "north", "/length": {"$gte": 13}}) == ["b2"]
    assert ids(docs, selector={"/flags": {"$eq": {"$note": "x"}}}) == ["b5"]
    assert ids(docs, selector={"/owner": {"name": "Okafor"}}) == ["b3"]
    assert ids(docs, selector={"/state": None}) == ["b3"]
    assert ids(docs, selector={"/moored": {"$elemMatch": {"/rope": "spring"}}}) == ["b4"]
    assert ids(docs, selector={"/length": {"$gt": "1"}}) == ["b5"] and ids(docs, selector={"/length": {"$gt": 10}}) == ["b1", "b2", "b4"]


def test_order_puts_missing_last_or_first(docs):
    """Null comes before strings, and what is missing after all."""
    assert ids(docs, sort=["/state"]) == ["b3", "b6", "b2", "b1", "b5", "b4"]
    assert ids(docs, sort=[{"path": "/state", "direction": "desc"}]) == ["b4", "b1", "b5", "b2", "b6", "b3"]
    assert ids(docs, sort=["/length"]) == ["b3", "b1", "b4", "b2", "b5", "b6"]
    assert ids(docs) == sorted(BODIES)


@pytest.mark.parametrize("sort", [[], ["/state"], [{"path": "/state", "direction": "desc"}], ["/pier", {"path": "/length", "direction": "desc"}]])
def test_pages_are_the_whole(docs, sort):
    whole, got, mark = ids(docs, sort=sort), [], None
    for _ in range(6):
        page = query.execute(docs, {"sort": sort, "limit": 2} | ({"bookmark": mark} if mark else {}))
        got += [r["id"] for r in page["results"]]
        mark = page["bookmark"]
        if not page["has_more"]:
            break
    assert got == whole and mark is None


def test_typed_pages(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(20)], "k int, x int")
    docs = Documents(df, "k")
    for direction in ("asc", "desc"):
        request = {"sort": [{"path": "/x", "direction": direction}], "limit": 7}
        whole = [r.k for r in query.page(docs, request | {"limit": 20}).collect()]
        got, mark = [], None
        while True:
            page = query.execute(docs, request | ({"bookmark": mark} if mark else {}))
            got += [int(r["id"]) for r in page["results"]]
            mark = page["bookmark"]
            if not mark:
                break
        assert got == whole


def test_bookmarks_are_bound(docs):
    mark = query.execute(docs, {"limit": 1})["bookmark"]
    with pytest.raises(EngineError) as e:
        query.execute(docs, {"limit": 1, "selector": {"/pier": "dry"}, "bookmark": mark})
    assert e.value.code == "invalid_bookmark"
    later = Documents(docs.df, "id", body="body", revision="revision", version="8")
    with pytest.raises(EngineError) as e:
        query.execute(later, {"limit": 1, "bookmark": mark})
    assert e.value.code == "bookmark_stale" and e.value.retryable
    for bad in ("", "zzz", mark[:-3] + "AAA", 5):
        with pytest.raises(EngineError) as e:
            query.execute(docs, {"limit": 1, "bookmark": bad or "!"})
        assert e.value.code == "invalid_bookmark"


def test_projection(docs):
    rows = {r["id"]: r["fields"] for r in query.execute(docs, {"fields": ["/state", "/moored/1"]})["results"]}
    assert rows["b1"] == {"/state": '"taken"', "/moored/1": '{"m":5,"rope":"stern"}'} and rows["b3"] == {"/state": "null"} and rows["b4"] == {"/moored/1": '{"rope":"spring"}'}
    whole = {r["id"]: r["body"].toPython() for r in query.execute(docs, {"limit": 3})["results"]}
    assert whole == {k: BODIES[k] for k in ("b1", "b2", "b3")}


def test_requests_are_checked(docs):
    for bad in ({"limit": 0}, {"limit": 501}, {"limit": True}, {"fields": []}, {"fields": [""]}, {"sort": [{"path": "/x", "direction": "up"}]}, {"what": 1}, {"search": {"query": "a", "fields": ["/t"]}, "sort": ["/x"]}):
        with pytest.raises(EngineError):
            query.execute(docs, bad)
    with pytest.raises(EngineError) as e:
        query.execute(docs, {"scan_threshold": 3})
    assert e.value.code == "index_required"


def test_point_reads(docs):
    assert query.get_one(docs, "b6").id == "b6"
    with pytest.raises(EngineError) as e:
        query.get_one(docs, "none")
    assert e.value.code == "document_not_found"
    assert [(r.asked, r.found) for r in query.get(docs, ["b2", "none", "b2"]).collect()] == [("b2", True), ("none", False), ("b2", True)]
    numbers = Documents(docs.df.sparkSession.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    asked = ["33", "033", "x", "7", str(2**70), "-1"]
    found = query.get(numbers, asked)
    assert [(r.asked, r.found) for r in found.collect()] == [(i, i in ("33", "7")) for i in asked]
    assert "In(o_orderkey, [" in found._jdf.queryExecution().executedPlan().toString() and query.get_one(numbers, "33").o_orderkey == 33


def test_plans(docs):
    catalog = Catalog()
    for name, fields in (("pier", ["/pier"]), ("state", ["/state"]), ("all", ["/pier", "/state", "/length"])):
        catalog.create_index({"name": name, "type": "structured", "fields": fields})
    catalog.create_index({"name": "text", "type": "full_text", "fields": ["/boat"]})
    indexes = list(catalog.indexes.values())
    plan = lambda r: query.plan(docs, r, indexes)
    assert plan({"selector": {"/pier": "dry", "/state": "free", "/length": {"$gt": 1}}})["selected_indexes"] == ["all"]
    assert plan({"selector": {"$or": [{"/pier": "a"}, {"/state": "b"}]}})["plan_kind"] == "union"
    assert plan({"selector": {"$or": [{"/pier": "a"}, {"/boat": "b"}]}})["plan_kind"] == "bounded_scan"
    assert plan({"selector": {"/pier": {"$ne": "a"}}})["plan_kind"] == "bounded_scan"
    assert plan({"search": {"query": "heron", "fields": ["/boat"]}})["plan_kind"] == "full_text"
    with pytest.raises(EngineError):
        plan({"index": "none"})
    assert "physical" in query.explain(docs, {"selector": {"/pier": "dry"}})
    with pytest.raises(EngineError) as e:
        catalog.create_index({"name": "pier", "type": "structured", "fields": ["/state"]})
    assert e.value.code == "index_name_conflict"


def test_top_k_is_one_operator(spark):
    docs = Documents(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    text = query.explain(docs, {"selector": {"/o_orderstatus": "F"}, "sort": ["/o_totalprice"], "limit": 5})["physical"]
    assert "TakeOrderedAndProject" in text and "EqualTo(o_orderstatus,F)" in text


def test_bookmarks_follow_the_files(spark, tmp_path):
    """Without a version of their own, bookmarks are bound to the files that were read."""
    from tessella.sources import documents as source

    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    mark = query.execute(source.table(spark, path, "id"), {"limit": 3})["bookmark"]
    assert [r["id"] for r in query.execute(source.table(spark, path, "id"), {"limit": 3, "bookmark": mark})["results"]] == ["3", "4", "5"]
    spark.range(10, 12).write.mode("append").parquet(path)
    with pytest.raises(EngineError) as e:
        query.execute(source.table(spark, path, "id"), {"limit": 3, "bookmark": mark})
    assert e.value.code == "bookmark_stale"


def test_search_is_served_by_the_index(docs, tmp_path):
    from tessella.operators.search import SearchIndex

    index = SearchIndex(docs.df.sparkSession, str(tmp_path), ["/boat"])
    index.rebuild(docs)
    served = Documents(docs.df, "id", body="body", revision="revision", version="7", extra={"search_index": index})
    for text, mode in (("heron", "all"), ("grey two", "any"), ("grey heron", "phrase"), ("wave", "prefix")):
        request = {"search": {"query": text, "fields": ["/boat"], "mode": mode}}
        plain, stored = (query.execute(d, request)["results"] for d in (docs, served))
        assert [(r["id"], round(r["rank"], 9)) for r in plain] == [(r["id"], round(r["rank"], 9)) for r in stored] and plain
    with pytest.raises(EngineError) as e:
        query.execute(served, {"search": {"query": "heron", "fields": ["/boat"], "max_candidates": 1}})
    assert e.value.code == "resource_limit"
    plan = query.select(served, query.normalize({"search": {"query": "heron", "fields": ["/boat"]}}))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,heron)" in plan or "In(token, [heron])" in plan
