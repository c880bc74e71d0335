"""Inverting documents where they are read."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shuffled import jobs_shuffled

from tessella import queries
from tessella.operators import search
from tessella.plans.binding import Documents
from tessella.sources.versions import Versions

TEXTS = [("1", "b a b"), ("2", None), ("3", ""), ("4", "the Émile the, 9 the"), ("5", "a " * 40 + "z"), ("6", "...")]
REPEATED = [("7", "a b"), ("7", "b c"), (None, "a"), (None, "d d")]


def model(rows):
    """token, id: positions, plainly; the empty token's are the lengths."""
    at, lengths = defaultdict(list), defaultdict(list)
    for id, text in rows:
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        for n, w in enumerate(words):
            at[w, id].append(n)
        lengths[id].append(len(words))
    return {k: (len(v), sorted(v)) for k, v in at.items()}, {("", k): (min(v), []) for k, v in lengths.items()}


def docs(spark, rows):
    return Documents(spark.createDataFrame(rows, "id string, text string"), "id")


def got(df):
    rows = df.collect()
    out = {(r.token, r.id): (r.tf, r.positions) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("rows", [TEXTS, TEXTS + REPEATED, []])
def test_entries_are_the_models(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "PART", 3)
    monkeypatch.setattr(search, "ROWS", 2)
    words, lengths = model(rows)
    assert got(search.postings(docs(spark, rows), (("text",),))) == words
    assert got(search.entries(docs(spark, rows), (("text",),))) == words | lengths
    assert got(search.arranged_entries(docs(spark, rows), (("text",),))) == words | lengths


def test_documents_are_inverted_without_a_shuffle(spark):
    for df in (search.postings(docs(spark, TEXTS), (("text",),)), search.entries(docs(spark, TEXTS), (("text",),))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_in_order_and_frequent_tokens_are_spread(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARE", 100)
    rows = [(str(n), f"the w{n % 50} v{n}") for n in range(900)]
    df = search.arranged_entries(docs(spark, rows), (("text",),)).withColumn("part", F.spark_partition_id())
    held = defaultdict(list)
    for r in df.collect():
        held[r.part].append((r.token, r.id))
    ranges = [held[k] for k in sorted(held)]
    assert all(r == sorted(r) for r in ranges) and sum(map(len, ranges)) == 3600 and len(ranges) == 4
    assert all(a[-1][0] <= b[0][0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert max(map(len, ranges)) < 1600


def test_a_refresh_shuffles_an_entry_once(spark, tmp_path):
    rows = [(str(n), f"a{n} b{n} c d e f g h") for n in range(300)]
    index = search.SearchIndex(spark, str(tmp_path), ["/text"])
    assert jobs_shuffled(spark, lambda: index.rebuild(docs(spark, rows), 1)) < 1.5 * 9 * 300
    new = docs(spark, [(id, "of the new") for id, _ in rows[::3]])
    assert jobs_shuffled(spark, lambda: index.refresh(new, 2)) < 5 * 4 * 100
    assert {r.id for r in index.search("the new", "phrase").collect()} == {id for id, _ in rows[::3]}
    assert {r.id for r in index.search("c d e", "phrase").collect()} == {id for id, _ in rows} - {id for id, _ in rows[::3]}


def test_phrases_of_a_built_index(spark, tmp_path):
    """Positions are those in the whole text, also of a text that is cut into parts or repeats its words."""
    rows = [("1", "x licensed under the y"), ("2", "licensed under licensed under the"), ("3", "under the licensed"), ("4", "licensed, under. THE"), ("5", "licensed under a the")]
    index = search.SearchIndex(spark, str(tmp_path), ["/text"])
    shuffled = jobs_shuffled(spark, lambda: index.rebuild(docs(spark, rows + [(f"n{n}", "the " * 9 + "end") for n in range(200)])))
    assert shuffled < 1.5 * (200 * 3 + 25)
    assert {r.id for r in index.search("licensed under the", "phrase").collect()} == {"1", "2", "4"}
    assert index.search("the the end", "phrase").count() == 200


ODD = ["Ünï Straße ΟΔΥΣΣΕΎΣ ΣΑΣ. İstanbul", "中文字 123٤٥ ⅷ² ȧb été", "𝒜𝟘 𐐀𐐨😀x 😀", "ǅ ª º _-'’a", "  x​y\0z�", "é", "😀", "", None, "ﬁ ŉ ẞ K Å", "a", "é😀", "𐐀"]


def test_tokens_on_bytes_are_the_engines(spark):
    """Cut on the bytes of many texts together, tokens are those of the regular expression, code point by code point."""
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rows = [(t,) for t in ODD * 2 + ["x".join(points[n : n + 300]) for n in range(0, len(points), 300)]]
    df = spark.createDataFrame(rows, "text string").coalesce(1).select(F.coalesce(F.lower("text"), F.lit("")).alias("low"), F.coalesce(search.tokenize(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    table = df.toArrow()
    runs = search._letters(spark)
    letter = np.repeat(np.arange(len(runs) + 1) % 2 == 1, np.diff(runs, prepend=0, append=0x110000))
    low = table["low"].combine_chunks()
    for a, b in ((0, len(low)), (3, len(ODD)), (5, 6), (7, 8), (0, 0)):
        words, sizes = search._tokens(low[a:b], letter)
        want = table["tokens"].to_pylist()[a:b]
        assert words.to_pylist() == [t for ts in want for t in ts] and sizes.tolist() == [len(ts) for ts in want]


def test_tokens_are_made_where_they_are_inverted(spark):
    """A text goes to be inverted as it is, not as an array of its tokens, and rows come in the order of an index."""
    rows = [(str(n), f"the w{n % 7} the a") for n in range(40)]
    df = search.postings(docs(spark, rows), (("text",),))
    assert "split(" not in df._jdf.queryExecution().executedPlan().toString()
    found = [(r.token, r.id) for r in spark.createDataFrame(df.toArrow()).collect()]
    one = search.postings(Documents(spark.createDataFrame(rows, "id string, text string").coalesce(1), "id"), (("text",),)).collect()
    assert [(r.token, r.id) for r in one] == sorted(found)


@pytest.mark.parametrize("rows", [TEXTS, TEXTS + REPEATED])
def test_postings_without_positions(spark, rows):
    df = search.postings(docs(spark, rows), (("text",),), positions=False)
    found = [(r.token, r.id, r.tf) for r in df.collect()]
    assert df.columns == ["token", "id", "tf"] and sorted(map(str, found)) == sorted(str((*k, n)) for k, (n, _) in model(rows)[0].items())


def test_the_postings_query_makes_no_positions(spark):
    df = queries.QUERIES["fts_postings"](spark, "/root/testdata/sf0.001")
    assert "positions" not in df._jdf.queryExecution().toString()


def test_an_index_is_built_from_texts(spark):
    """Also for an index the JVM makes no arrays of tokens."""
    plan = search.arranged_entries(docs(spark, TEXTS), (("text",),))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "MapInArrow" in plan


def test_an_index_is_shuffled_and_stored_in_blocks(spark, tmp_path):
    """Neither a shuffle nor a table has a row of each word and document."""
    rows = [(str(n), f"a b c d e f g h w{n % 5}") for n in range(300)]
    index = search.SearchIndex(spark, str(tmp_path), ["/text"])
    assert jobs_shuffled(spark, lambda: index.rebuild(docs(spark, rows), 1)) < 2 * 300 < 10 * 300 / 4
    (layer,) = index.versions.state()["layers"]
    assert layer["rows"] == 10 * 300 and spark.read.parquet(layer["folder"] + "/rows").count() < 100
    words, lengths = model(rows)
    assert got(index.read()) == words | lengths
    assert got(index.read(F.col("token") == "w3")) == {k: v for k, v in words.items() if k[0] == "w3"}


def test_blocks_hold_the_entries(spark, monkeypatch):
    """Through bytes and ranges, whatever is cut: ids that are null, wide or empty, words that are frequent, long texts."""
    for name, most in {"BLOCK": 3, "PLACES": 4, "ROWS": 5, "PART": 60}.items():
        monkeypatch.setattr(search, name, most)
    rows = [*TEXTS, (None, "a b"), ("", "b Ünï"), ("é" * 300, "the a"), ("8", "x " * 300 + "the"), *((f"n{n}", "the a b") for n in range(20))]
    runs = search._letters(spark)
    hashes = np.random.default_rng(5).permutation(len(rows)).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([(t or "").lower() for _, t in rows]), pa.array(hashes)], ["id", "text", "h"])
    words, lengths = model(rows)
    for ends in ([], [("", 9), ("b", 4), ("b", 11), ("the", 7), ("zz", 0)]):
        sent, found, seen = list(search._send(iter([batch, batch.slice(0, 0)]), runs, ends)), {}, []
        for part in range(len(ends) + 1):
            mine = [x.filter(pa.array([p == part for p in x["part"].to_pylist()])) for x in sent]
            blocks = list(search._receive(iter(mine)))
            assert all(b["entries"].to_numpy().max() <= 3 for b in blocks)
            tokens = [t for b in blocks for t in b["token"].to_pylist()]
            assert tokens == sorted(tokens)
            for r in (r for b in search._open(iter(blocks)) for r in b.to_pylist()):
                assert (r["token"], r["id"]) not in found
                found[r["token"], r["id"]] = r["tf"], r["positions"]
                seen.append((part, r["token"], int(hashes[[i for i, _ in rows].index(r["id"])])))
        assert found == words | lengths
        assert all(part == sum(e < (t, h) for e in ends) for part, t, h in seen)


def test_numbers_of_every_width():
    rows = [[0, 255], [], [256, 1], [70_000], [2**31 - 1, 5, 0]]
    column = pa.array([search._narrow(np.array(r, np.int64)).tobytes() for r in rows], pa.binary())
    for a, b in ((0, 5), (1, 4), (1, 2)):
        assert search._numbers(column[a:b], np.array([len(r) for r in rows[a:b]])).tolist() == [n for r in rows[a:b] for n in r]


def test_layers_in_blocks_are_merged(spark, tmp_path):
    """Layers are counted by entries; a base that is made of them, or was written as entries, is read like any other."""
    rows = [(str(n), "the a b the") for n in range(20)] + [("x", None)]
    Versions(spark, str(tmp_path), "postings").write(search.arranged_entries(docs(spark, rows), (("text",),)), sequence=1)
    index = search.SearchIndex(spark, str(tmp_path), ["/text"])
    assert got(index.read()) == (lambda w, n: w | n)(*model(rows)) and index.search("b the", "phrase").count() == 20
    new = [("1", "b the"), ("y", "the b"), ("x", "a")]
    index.refresh(docs(spark, new), 2)
    assert [x["rows"] for x in index.versions.state()["layers"]] == [81, 8]
    index.refresh(docs(spark, [(str(n), "c c") for n in range(2, 20)]), 3)
    after = [("0", "the a b the"), *new, *((str(n), "c c") for n in range(2, 20))]
    assert len(index.versions.state()["layers"]) == 1 and got(index.read()) == (lambda w, n: w | n)(*model(after))
    assert {r.id for r in index.search("b the", "phrase").collect()} == {"0", "1"} and index.search("c c", "phrase").count() == 18
