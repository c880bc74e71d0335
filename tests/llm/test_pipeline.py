"""The pipeline against its stages done plainly."""

import base64
import hashlib
import importlib
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import jaccard
from tests.llm.test_secrets import brute

WORDS = {"en": "the and of with that this from house river stone", "de": "der und die mit dass dieser von haus straße fluss", "fr": "le la de avec que cette depuis maison été rivière"}


def documents():
    rng = np.random.default_rng(12)
    rows = []
    for i in range(90):
        lang = list(WORDS)[i % 3]
        text = " ".join(rng.choice(WORDS[lang].split(), 80)) + f" unique{i}"
        if i % 9 == 4:
            text += " password=hunter2hunter2 AKIA" + "Q7" * 9
        rows.append([10 * i, text, lang, f"s{i % 4}", len(text)])
        if i % 5 == 0:
            copy = text + " end" if i % 2 else text
            rows.append([10 * i + 1, copy, lang, "s9", len(copy)])
    rows += [[5001, None, "en", "s0", None], [5002, "", "en", "s0", 0], [5003, "123 !!! 456", "en", None, 11], [None, None, None, None, None]]

    def more(i, n, end=""):
        text = " ".join(rng.choice(WORDS["en"].split(), 80)) + f" other{n}" + end
        return [i, text, "en", "s1", len(text)]

    secret = " token: q9w8e7r6t5y4"
    shared = [more(7001, 1), more(7001, 2, secret)]  # one id, two texts
    rows += [*shared, more(None, 3, secret), more(None, 4), [None, rows[0][1], "en", "s2", 1]]  # without ids: two unique texts, and a copy
    rows += [more(7002, 5, secret)] * 3 + [rows[-4]] * 2  # rows that are repeated
    return rows


def stays(rows):
    """Of each group of texts, which differ in " end" at most, the row of least id; none is last."""
    best = {}
    for i, t, *_ in rows:
        if t and any(map(str.isalpha, t)):
            key = t.removesuffix(" end")
            mine = (i is None, i or 0, t)
            best[key] = min(best.get(key, mine), mine)
    return [(None if none else i, t) for none, i, t in best.values()]


def masked(text):
    out, at = "", 0
    for start, _, stop in sorted(brute(text)):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, stop)
    return out + text[at:]


def test_pipeline(spark, tmp_path):
    """Against each stage done plainly, with ids that are null, shared and repeated: no text is lost, none is there
    twice, and no secret is left."""
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(jaccard(t, t.removesuffix(" end")) > 0.9 for _, t, *_ in rows if t)
    kept = stays(rows)
    assert sum(i is None for i, _ in kept) == 2 and [i for i, _ in kept].count(7001) == 2 and [i for i, _ in kept].count(7002) == 1
    want = Counter((i, tuple(tik.encode_ordinary(masked(t))), hashlib.sha256(masked(t).encode()).hexdigest()) for i, t in kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got)
    assert not [(i, n, tik.decode(list(ids))[-60:]) for (i, ids, _), n in (found - want).items()] and not [(i, n, tik.decode(list(ids))[-60:]) for (i, ids, _), n in (want - found).items()]
    assert all(r.n_tokens == len(r.ids) for r in got)
    texts = [tik.decode(list(r.ids)) for r in got]
    assert not any("hunter2" in t or "q9w8e7" in t or "Q7Q7" in t for t in texts)


def test_stages_keep_the_columns(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("clash"))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        out = stage(spark, docs, "/nowhere")
        assert out.columns == columns, name
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert all(r.n_chars == len(r.text) for r in docs.where("doc_id is not null").collect())
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/nowhere").count() == 0, name


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "tessella.llm"):
                raise ModuleNotFoundError(f"No module named '{name}'", name=name)

    held = {n: sys.modules[n] for n in list(sys.modules) if n == "corpus_pipeline" or n.startswith("tessella.llm")}
    for n in held:
        monkeypatch.delitem(sys.modules, n)
    monkeypatch.delattr(sys.modules["tessella"], "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert "sel_eq_range_sort" in entry.queries() and "pipeline" not in entry.queries() and "op1_sharding" not in entry.oracle_sql()
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(__spark_entry__).queries()
