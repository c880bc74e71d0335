"""Views, federation, full text, metrics."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.errors import EngineError
from tessella.operators import federation, metrics, search, views
from tessella.plans.binding import Documents


def bodies(spark, rows):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in rows], "id string, text string")
    return Documents(df.select("id", F.parse_json("text").alias("body")), "id", body="body")


ROWS = [("a", {"breed": "x", "pen": 1, "score": 2}), ("b", {"breed": "x", "pen": 1.0, "score": "no"}), ("c", {"breed": None, "pen": 2, "score": 5}), ("d", {"breed": [1], "pen": 2, "score": 5}), ("e", {"pen": 1}), ("f", {"breed": False, "pen": 1}), ("g", {"breed": "y", "pen": 3, "score": -1.5})]


def view(key=("/breed", "/pen"), value="/score", reducer=None):
    return views.define({"name": "v", "key": [{"path": k} for k in key], "value": {"path": value}, "reducer": reducer})


def test_map_rows(spark):
    docs = bodies(spark, ROWS)
    assert [r.id for r in views.query(docs, view()).collect()] == ["c", "f", "a", "b", "g"]  # null, false, strings
    values = {r.id: r.value for r in views.rows(docs, view()).collect()}
    assert values == {"a": "2", "b": '"no"', "c": "5", "f": None, "g": "-1.5"}


def test_reducers(spark):
    docs = bodies(spark, ROWS)
    by = lambda reducer, level: [tuple(r)[level:] for r in views.query(docs, view(reducer=reducer), {"group_level": level}).collect()]
    assert by("_count", 1) == [(1,), (1,), (2,), (1,)] and by("_sum", 1) == [(5.0,), (0.0,), (2.0,), (-1.5,)]
    assert by("_min", 0) == [(-1.5,)] and by("_max", 1) == [(5.0,), (None,), (2.0,), (-1.5,)]
    assert by("_stats", 0) == [(3, 5.5, -1.5, 5.0, 31.25)] and by("_count", 2) == [(1,), (1,), (2,), (1,)]
    nothing = Documents(docs.df.limit(0), "id", body="body")
    assert views.query(nothing, view(reducer="_count"), {"group_level": 0}).count() == 0
    with pytest.raises(EngineError):
        views.query(docs, view(reducer="_count"), {"group_level": 3})


def test_ranges(spark):
    docs = bodies(spark, ROWS)
    got = lambda **o: [r.id for r in views.query(docs, view(), o).collect()]
    assert got(key=["x", 1]) == ["a", "b"] and got(key=["x"]) == []
    assert got(start_key=["x"]) == ["a", "b", "g"] and got(end_key=["x"]) == ["c", "f"]
    assert got(start_key=[None], end_key=["x", 1]) == ["c", "f", "a", "b"] and got(start_key=[None], end_key=["x", 1], inclusive_end=False) == ["c", "f"]


@pytest.mark.parametrize("reducer", [None, "_sum"])
def test_view_pages(spark, reducer):
    docs = bodies(spark, ROWS)
    v, whole, got, mark = view(reducer=reducer), None, [], None
    whole = [tuple(r) for r in views.query(docs, v).collect()]
    while True:
        page = views.execute(docs, v, {"limit": 2} | ({"bookmark": mark} if mark else {}))
        got += [tuple(r) for r in page["rows"]]
        mark = page["bookmark"]
        if not mark:
            break
    assert got == whole


def test_exact_sums(spark):
    rng = random.Random(3)
    lists = {"big": [1e16, 1.0, -1e16], "tiny": [5e-324] * 3, "mixed": [rng.uniform(-1, 1) * 10 ** rng.randint(-150, 150) for _ in range(200)], "third": [0.1] * 10, "zero": [0.0], "powers": [2.0**k for k in range(-60, 60)]}
    rows = [(f"{k}{n}", {"breed": k, "pen": 1, "score": x}) for k, xs in lists.items() for n, x in enumerate(xs)]
    df = spark.createDataFrame([(i, b["breed"], float(b["score"])) for i, b in rows], "id string, breed string, score double").repartition(4)
    docs = Documents(df, "id")
    got = {r.key0.str: r for r in views.query(docs, view(key=("/breed",), reducer="_stats"), {}).collect()}
    from fractions import Fraction

    for k, xs in lists.items():
        assert got[k].sum == math.fsum(xs) and got[k]["count"] == len(xs) and got[k].min == min(xs)
        square = sum(Fraction(x) ** 2 for x in xs)
        if k != "mixed":
            assert got[k].sumsqr == float(square)
    with pytest.raises(Exception, match="resource_limit"):
        huge = Documents(spark.createDataFrame([("a", "k", 1e308), ("b", "k", 1e308)], "id string, breed string, score double"), "id")
        views.query(huge, view(key=("/breed",), reducer="_sum")).collect()


def test_consistency_is_checked(spark):
    docs = bodies(spark, ROWS)
    for mode in views.CONSISTENCY:
        assert views.query(docs, view(), {"consistency": mode}).count() == 5
    with pytest.raises(EngineError):
        views.query(docs, view(), {"consistency": "sometimes"})


def test_catalog_lists_and_rebuilds(spark, tmp_path):
    catalog = views.Catalog()
    catalog.create_index({"name": "text", "type": "full_text", "fields": ["/title"]})
    catalog.create_index({"name": "pen", "type": "structured", "fields": ["/pen"]})
    catalog.create_view({"name": "v", "key": [{"path": "/pen"}]})
    index = search.SearchIndex(spark, str(tmp_path), ["/title"])
    catalog.keep("index", "text", index)
    docs = bodies(spark, [("1", {"title": "alpha"})])
    catalog.rebuild("index", "text", docs, 4)
    catalog.rebuild("view", "v", docs, 4)
    assert [(i["name"], i["stored"], i["sequence"]) for i in catalog.list_indexes()] == [("pen", False, None), ("text", True, 4)]
    assert [v["name"] for v in catalog.list_views()] == ["v"] and {r.id for r in index.search("alpha").collect()} == {"1"}
    with pytest.raises(EngineError):
        catalog.rebuild("view", "w", docs, 4)
    catalog.drop_index("text")
    with pytest.raises(EngineError):
        catalog.keep("index", "text", index)


def test_definitions():
    for bad in ({"name": "", "key": []}, {"name": "v", "key": [{"path": "x"}]}, {"name": "v", "key": [1] * 9}, {"name": "v", "key": [], "reducer": "_avg"}, {"name": "v", "key": [{"literal": []}]}):
        with pytest.raises(EngineError):
            views.define(bad)
    catalog = views.Catalog()
    catalog.create_view({"name": "v", "key": []})
    with pytest.raises(EngineError) as e:
        catalog.create_view({"name": "v", "key": [{"literal": 1}]})
    assert e.value.code == "view_name_conflict"
    catalog.drop_view("v")
    with pytest.raises(EngineError):
        catalog.drop_view("v")


def test_federation(spark):
    sources = {"a": bodies(spark, [("a", {"score": 1}), ("z", {"score": 3})]), "b": bodies(spark, [("b", {"score": 2}), ("a", {"score": 4})])}
    request = {"sort": ["/score"], "fields": ["/score"]}
    assert [r["id"] for r in federation.execute(sources, request)["results"]] == ["a", "b", "z", "a"]
    got, mark = [], None
    while True:
        page = federation.execute(sources, request | {"limit": 1} | ({"bookmark": mark} if mark else {}))
        got += [(r[federation.SOURCE], r["id"]) for r in page["results"]]
        mark = page["bookmark"]
        if not mark:
            break
    assert got == [("a", "a"), ("b", "b"), ("a", "z"), ("b", "a")]
    first = federation.execute(sources, request | {"limit": 1})["bookmark"]
    with pytest.raises(EngineError) as e:
        federation.execute(sources, request, budget=3)
    assert e.value.code == "resource_limit" and len(federation.execute(sources, request, budget=4)["results"]) == 4
    sources["a"].version = "9"
    with pytest.raises(EngineError) as e:
        federation.execute(sources, request | {"limit": 1, "bookmark": first})
    assert e.value.code == "bookmark_stale"
    for bad in ({"search": {"query": "x"}}, {"index": "i"}):
        with pytest.raises(EngineError):
            federation.execute(sources, bad)
    with pytest.raises(EngineError):
        federation.execute({}, {})


def test_full_text(spark):
    docs = bodies(spark, [("1", {"title": "alpha beta"}), ("2", {"title": "alpha only"}), ("3", {"title": "alpha beta gamma"}), ("4", {"title": "beta alpha"}), ("5", {"title": 7})])
    find = lambda text, mode: {r.id for r in search.ranked(docs, search.normalize({"query": text, "fields": ["/title"], "mode": mode})).collect()}
    assert find("Alpha beta", "all") == {"1", "3", "4"} and find("beta only", "any") == {"1", "2", "3", "4"}
    assert find("alpha beta", "phrase") == {"1", "3"} and find("alpha", "phrase") == {"1", "2", "3", "4"} and find("al be", "prefix") == {"1", "3", "4"}
    ranked = search.ranked(docs, search.normalize({"query": "beta gamma", "fields": ["/title"], "mode": "any"})).orderBy("rank", "id")
    assert [r.id for r in ranked.collect()][0] == "3"
    with pytest.raises(EngineError):
        find("  ,", "all")
    with pytest.raises(EngineError) as e:
        search.ranked(docs, search.normalize({"query": "alpha", "fields": ["/title"], "max_candidates": 2}))
    assert e.value.code == "resource_limit"
    index = search.postings(docs, (("title",),))
    assert {r.id for r in search.search_postings(index, ["alpha", "beta"]).collect()} == {"1", "3", "4"}
    assert {r.id for r in search.search_postings(index, ["ga", "al"], "prefix").collect()} == {"3"}


def test_search_index(spark, tmp_path):
    rows = [("1", {"title": "alpha beta"}), ("2", {"title": "alpha only"}), ("3", {"title": "gamma alpha beta"}), ("4", {"title": "beta alpha"})]
    index = search.SearchIndex(spark, str(tmp_path), ["/title"])
    with pytest.raises(EngineError):
        index.search("alpha")
    index.rebuild(bodies(spark, rows), 4)
    find = lambda text, mode: {r.id for r in index.search(text, mode).collect()}
    assert find("alpha beta", "all") == {"1", "3", "4"} and find("Alpha Beta", "phrase") == {"1", "3"} and find("on ga", "any") == set() and find("be", "prefix") == {"1", "3", "4"}
    changed = bodies(spark, [("1", {"title": "delta"}), ("5", {"title": "alpha beta"})])
    index.refresh(changed, 6)
    index.refresh(bodies(spark, [("2", {"title": "never"})]), 5)
    assert find("alpha beta", "phrase") == {"3", "5"} and find("delta", "any") == {"1"} and find("never", "any") == set()
    index.versions.drop_old()
    assert find("only", "all") == {"2"}


@pytest.mark.parametrize("text, tokens", [("  a   b\tc\nd  ", ["a", "b", "c", "d"]), ("a,b;c:d.e!f?g", list("abcdefg")), ("Hello WORLD", ["hello", "world"]), ("café 日本語", ["café", "日本語"]), ("", [])])
def test_tokens(spark, text, tokens):
    assert spark.range(1).select(search.tokenize(F.lit(text)).alias("t")).first().t == tokens


def test_metrics(spark):
    results = spark.createDataFrame([(1, d, k) for k, d in enumerate("abcd", 1)] + [(2, "a", 1)], "query_id int, doc_id string, rank int")
    judged = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "x", 1), (2, "a", 0), (3, "a", 1)], "query_id int, doc_id string, grade int")
    got = {r.query_id: r for r in metrics.retrieval(results, judged, 3).collect()}
    dcg, ideal = 1 + 3 / 2, 3 + 1 / math.log2(3) + 1 / 2
    assert abs(got[1].ndcg - dcg / ideal) < 1e-12 and abs(got[1].recall - 2 / 3) < 1e-12 and abs(got[1].average_precision - (1 + 2 / 3) / 3) < 1e-12
    assert tuple(got[2])[1:] == (0.0, 0.0, 0.0) and tuple(got[3])[1:] == (0.0, 0.0, 0.0)
