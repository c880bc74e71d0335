import hashlib
import re

from pyspark.sql import functions as F

from tessella.llm import secrets
from tessella.llm.pii import digest
from tests.llm import cases

KINDS = ["assign", "access", "hex"]
WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
RX = {
    "assign": rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(RX[kind], text or ""):
            if (len(m[2]) if k == 0 else len(m[0])) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_definitions(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in digest(secrets.find_secrets(cases.frame(spark)), secrets.KINDS).collect())
    want = []
    for i, t, *_ in cases.rows():
        b = brute(t)
        text = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()
        want.append((i is None, i or 0, text, *(sum(k == n for _, k, _ in b) for n in range(3))))
    assert got == sorted(want)


def test_automaton_knows_its_format():
    import random

    rng = random.Random(1)
    keys = ["SG." + "".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    a = secrets.infer(keys)
    assert len(a.step) < 60
    usual = secrets.ordinary(["the-2nd-edition", "covid-19", "thing", "another", "v1.2.3-rc1", "2024-01-01"])
    good = "SG." + "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    assert a.bits(good) - usual.bits(good) > 0.5 * len(good)
    for bad in ("the-second-edition-2020", "2024-01-01T00:00:00", "section-12.4.5.6.7.8.9"):
        assert a.bits(bad) - usual.bits(bad) < 0


def test_ordinary_tokens_are_those_of_all_documents(spark, monkeypatch):
    """Every distinct candidate and every word count, past the first of a document and beyond any sample."""
    import random

    rng, seen = random.Random(3), []
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [" ".join([word(6), f"{word(9)}-{100 + i}", word(7), word(3), word(8)]) for i in range(1500)]
    texts += ["password=hunter2hunter2", None, "", texts[0]]
    monkeypatch.setattr(secrets, "model", lambda counts, model=secrets.model: seen.append(counts) or model(counts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert secrets.find_secrets(docs).count() == len(texts)
    tokens = {t for x in texts for t in (x or "").split() if "-" in t}
    words = [w for x in texts for w in (x or "").split() if w.isalpha() and len(w) >= 5]
    for counts, among in zip(seen, (tokens, words), strict=True):
        want = {}
        for t in among:
            for pair in zip(["^", *map(secrets.symbol, t)], [*map(secrets.symbol, t), "$"], strict=True):
                want[pair] = want.get(pair, 0) + 1
        last, then = [*secrets.SYMBOLS, "^"], [*secrets.SYMBOLS, "$"]
        got = {(last[a], then[b]): n for a, row in enumerate(counts.tolist()) for b, n in enumerate(row) if n}
        assert got == want


def plain_masked(text, added=()):
    out, at = "", 0
    for start, stop in sorted([(start, stop) for start, _, stop in brute(text)] + list(added)):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, stop)
    return out + text[at:]


def test_redact_masks_every_row_by_its_own_text(spark):
    docs = cases.frame(spark)
    rows = docs.withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0))).collect()
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = {r.doc_id: [(x.start, x.stop) for x in r.added] for r in secrets.find_secrets(by_text).collect()}
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "", r.fp) for r in out.collect())
    assert any(found.values())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, r.text is None, plain_masked(r.text or "", found.get(r.h, ())), "clash") for r in rows)
    assert all(r.text is None or r.n_chars is None or r.n_chars == len(r.text) for r in out.collect())


def test_redact_without_ids_and_with_shared_ids(spark):
    shape = "doc_id long, text string, row string, _id long, new string, base int"
    rows = [(None, "password=hunter2hunter2", "a", 1, "n", 1), (None, "nothing here", "b", 2, "n", 1), (7, "token: abcdef1 é", "c", 3, "n", 1), (7, "nothing here", "d", 4, "n", 1),
            (7, "token: abcdef1 é", "c", 3, "n", 1), (8, None, None, None, None, None), (9, "", "e", 5, "n", 1), (None, "AKIA" + "Q7" * 9 + "x" * 100_000 + " secret=a1b2c3", "f", 6, "n", 1)]
    out = secrets.redact(spark.createDataFrame(rows, shape).repartition(3))
    assert out.columns == ["doc_id", "text", "row", "_id", "new", "base"]
    want = [(i, t if t is None else plain_masked(t), *more) for i, t, *more in rows]
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert secrets.redact(spark.createDataFrame([], shape)).count() == 0


def test_learnt_probabilities_are_those_of_the_automaton_that_spoke():
    """A known automaton: up to three digits or letters, nine in ten of them digits, then a dash and again, or the end."""
    import random

    rng = random.Random(8)

    def speak():
        out = ""
        while True:
            out += rng.choice("0123456789") if rng.random() < 0.9 else rng.choice("xyz")
            if rng.random() < 0.2:
                return out

    a = secrets.infer([speak() for _ in range(2000)])
    first = a.step[0]
    assert abs(2 ** first["d"][1] - 0.9) < 0.05 and abs(2 ** first["l"][1] - 0.1) < 0.05
    state = first["d"][0]
    assert abs(2 ** a.step[state]["d"][1] - 0.72) < 0.05 and abs(2 ** a.step[state]["l"][1] - 0.08) < 0.05 and abs(2 ** a.end[state] - 0.2) < 0.05
    assert len(a.step) <= 6
    fixed = secrets.infer(["".join(rng.choice("0123456789") if rng.random() < 0.9 else "z" for _ in range(20)) for _ in range(2000)])
    state = 0
    for _ in range(20):
        assert abs(2 ** fixed.step[state]["d"][1] - 0.9) < 0.05
        state = fixed.step[state]["d"][0]
    assert 2 ** fixed.end[state] > 0.9


def test_added_spans_on_planted_formats(spark):
    """Credentials without the words that name them are found; versions, dates, names and numbers are not."""
    import random

    rng = random.Random(4)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base36 = "abcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: some("etaoinshrdlucmfw", rng.randint(3, 9))
    number = lambda: str(rng.randint(1, 2030))
    ordinary = [
        lambda: f"{word()}-{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{word()}-{number()}-{word()}-{word()}", lambda: f"10.{rng.randint(1000, 9999)}/{number()}.{number()}.{number()}",
        lambda: f"www.{word()}.org/{word()}/page{number()}", lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T00.{rng.randint(10, 59)}.{rng.randint(10, 59)}", lambda: f"{word()}.{word()}.v{number()}.{number()}",
    ]
    rows, planted = [], {}
    for i in range(1200):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words[5] = f"token={some(base36, 24)}"
        elif i % 12 == 1:
            words[9] = planted.setdefault(i, some(base36, 24))
        else:
            words[9], words[20] = rng.choice(ordinary)(), rng.choice(ordinary)()
        rows.append((i, " ".join(words)))
    hits = wrong = 0
    for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.doc_id][1]
        added = [text[x.start : x.stop] for x in r.added]
        hits += planted.get(r.doc_id) in added
        wrong += sum(x != planted.get(r.doc_id) for x in added)
    assert hits >= 0.9 * len(planted) and wrong <= 0.1 * hits


def test_empty(spark):
    assert digest(secrets.find_secrets(cases.empty(spark)), secrets.KINDS).count() == 0
