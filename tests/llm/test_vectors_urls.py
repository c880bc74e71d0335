"""Embeddings and urls against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import embedding_dedup, neighbours, urls
from tests.llm.test_documents import components

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.standard_normal((6, 12))
    for i in range(240):
        v = rng.standard_normal(12) if i % 3 else base[i % 6] + 0.05 * rng.standard_normal(12)
        rows.append([i, v.astype(np.float32).tolist(), [0, 1, None][i % 7 % 3]])
    for i in range(60):  # a large group of equal ones
        rows.append([300 + i, base[0].astype(np.float32).tolist(), 1])
    rows += [[400, None, 0], [401, [], 0], [402, [0.0] * 12, 0], [403, [math.nan] + [1.0] * 11, 0], [404, [math.inf] + [1.0] * 11, 0], [405, [None] + [1.0] * 11, 0], [406, [1.0] * 5, 0], [5, rows[5][1], rows[5][2]]]
    return rows


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [16, 2048])
def test_near_duplicates(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("cid", F.lit("clash")).withColumn("root", F.lit(1))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.98, block).collect())

    def near(a, b):
        x, y = rows[a], rows[b]
        if x[2] is None or x[2] != y[2] or not fine(x[1]) or not fine(y[1]) or len(x[1]) != len(y[1]):
            return False
        p, q = np.array(x[1], float), np.array(y[1], float)
        return p @ q / math.sqrt((p @ p) * (q @ q)) >= 0.98

    n = len(rows)
    links = [sum(near(a, b) for b in range(n) if b != a) for a in range(n)]
    named = components({a: rows[a][0] for a in range(n)}, near)
    assert max(links) >= 60
    assert got == Counter((rows[a][0], links[a], named[a], rows[a][0] == named[a]) for a in range(n))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [32, 2048])
def test_neighbours(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {r[0]: np.array(r[1], float) for r in rows if fine(r[1]) and len(r[1]) == 12}
    asked = [i for i in good if i % 20 == 0]
    assert set(got) == set(asked)
    recall = []
    for q in asked:
        best = sorted((-(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        mine = got[q]
        assert [k for k, *_ in mine] == list(range(1, 21))
        assert all(abs(s - good[q] @ good[i]) < 1e-9 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        recall.append(len({i for _, i in best} & {i for _, i, _ in mine}) / 20)
    assert np.mean(recall) >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame(vectors()[:4], VECTORS)
    assert neighbours.search(df, F.col("vec_id") % 20 == 0).count() == 3
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_scan_of_all_is_exact(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    a = neighbours.search(df, F.col("vec_id") % 20 == 0, 20, share=9.0).collect()
    b = neighbours.search(df, F.col("vec_id") % 20 == 0, 20, share=9.0, leaf=30, trees=3, block=8).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in a} == {(r.query_id, r["rank"], r.vec_id) for r in b}


def test_neighbours_of_each_length(spark):
    """Vectors of every length are queries and candidates among those of their own."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal([3, 5, 8, 1][i % 4]).tolist()) for i in range(200)] + [(1000, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 7, share=9.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    v = dict(rows)
    for q in range(0, 200, 20):
        want = sorted((-float(np.dot(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q]))[:7]
        assert sorted(got[q]) == [(k, i) for k, (_, i) in enumerate(want, 1)]
    assert set(got) == set(range(0, 200, 20))


def test_recall_on_many_vectors(spark):
    """Measured against brute force: on vectors that fill their dimension, by leaves that hold less than the table, and on
    such that do not, by few of them."""
    rng = np.random.default_rng(5)
    for x, most in ((rng.standard_normal((12_000, 48)), 1.0), (rng.standard_normal((12_000, 4)) @ rng.standard_normal((4, 48)), 0.25)):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
        got = {}
        for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        asked = np.arange(0, len(x), 20)
        product = x[asked].astype(float) @ x.T.astype(float)
        product[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-product, 20, axis=1)[:, :20]
        assert np.mean([len(got[q] & set(b)) / 20 for q, b in zip(asked.tolist(), best.tolist(), strict=True)]) >= 0.9
        fit = x.astype(float)
        forest = [neighbours.Tree(fit, 47, rng) for _ in range(2)]
        assert neighbours.enough(forest, fit, fit[:64], np.arange(64), 20, neighbours.RECALL) < most


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/x?q#f", "https://a.b.example.org/en/12", "http://example.org", "http://example.org?x=/es/", "x://y://z/p", "http://notexample.org/es/",
    "http://www.com/de/1", "http://com/fr/", "http://a.com/fr", "http://org/", "ftp://u:p@a.org:80/x", "http://a..org/x", "http://.org/", "http://ex.org#/es/", "http://É.Org/Ä", "http://x.net/a/b/c",
]


def plain(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[1], best[2] if best else default


@pytest.mark.parametrize("opened", [0, 1 << 25])  # seeds are shuffled, or broadcast
def test_url_rules(spark, monkeypatch, opened):
    from tessella.llm.queries import URL_RULES

    monkeypatch.setattr(urls, "OPEN", opened)
    rules = [*URL_RULES, ("block", "x.net", "/a/"), ("allow", "x.net", "/a/b/"), ("block", "net", "")]
    rows = [(n, u) for n, u in enumerate(URLS * 3)] + [(None, "http://x.net/a/b/z"), (7, "http://hot.example.org/es/" + "y" * 5000)] + [(1000 + i, f"http://h{i % 5}.example.org/en/{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3).withColumn("key", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = Counter(tuple(r) for r in urls.judge(df, urls.rules_frame(spark, rules), parts=7).collect())
    assert got == Counter((i, *plain(u, rules, "allow")) for i, u in rows)
    assert urls.judge(df.limit(0), urls.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in urls.judge(df, urls.rules_frame(spark, rules).limit(0), default="block").collect()} == {"block"}


@pytest.mark.parametrize("times", [3.0, 100.0])
def test_neighbours_with_vectors_of_unequal_lengths(spark, times):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= times
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    product, found = x.astype(float) @ x.astype(float).T, 0
    for q in range(0, 2000, 20):
        product[q, q] = -np.inf
        found += len(got[q] & set(np.argsort(-product[q])[:20].tolist()))
    assert found / (20 * 100) >= 0.9
