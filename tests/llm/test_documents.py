"""The operators on documents against plain versions of themselves, on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import bpe, language, mixing, sharding, simhash
from tests.llm import cases


def crc(t):
    return zlib.crc32((t or "").encode())


def size(t):
    return len((t or "").encode()) + 1


# Sharding


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_contiguous_and_even(spark, shards):
    got = sharding.shard_by_bytes(cases.frame(spark), shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), crc(t)) for i, t, *_ in cases.rows())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in order]
    assert keys == sorted(keys)
    total, upto = sum(r["size"] for r in got), 0
    for k in range(shards):
        mine = [r for r in order if r.shard == k]
        assert [r.slot for r in mine] == list(range(len(mine)))
        for r in mine:
            assert r.start == upto
            middle = upto + r["size"] / 2
            assert k == min(shards - 1, int(middle * shards // total))
            upto += r["size"]


def test_shards_of_nothing_and_of_a_giant(spark):
    assert sharding.shard_by_bytes(cases.empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "x" * 1000), (2, "y"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.shard) for r in sharding.shard_by_bytes(df).orderBy("doc_id").collect()] == [(1, 3), (2, 7), (3, 7)]


# Mixing


def test_schedule_meets_every_deadline():
    for shares in ([1], [1, 1], [3, 2, 5], [1, 7, 11, 1], [500, 300, 199, 1]):
        d, had = sum(shares), Counter()
        for t, (s, j, release, due) in enumerate(mixing.order(shares, shares), 1):
            assert j == had[s] and release < t <= due
            had[s] += 1
            assert all(abs(t * n / d - had[k]) < 1 for k, n in enumerate(shares))
        assert all(had[k] == n for k, n in enumerate(shares))


@pytest.mark.parametrize("segment", [1, 7, 64, 256])
def test_segments_are_the_schedule_slot_by_slot(spark, segment):
    """Each segment finds its own beginning: together they are what one queue gives, on weights of all kinds."""
    rng = np.random.default_rng(segment)
    trials = [([1], [5]), ([3, 2, 5], [40, 7, 31]), ([0, 0, 2], [3, 4, 5]), ([1, 10**17, 3 * 10**17 + 1], [2, 60, 90]), ([1, 1, 1, 1], [9, 9, 9, 9]), ([7, 0], [20, 0])]
    for _ in range(4):
        n = int(rng.integers(2, 9))
        trials.append((mixing.whole_shares((rng.random(n) ** 3 * [1, 0.01][int(rng.integers(0, 2))] + 1e-4).tolist()), rng.integers(1, 60, n).tolist()))
    for shares, blocks in trials:
        got = sorted((r.slot, r.source, r.block, r.release, r.deadline) for r in mixing.slots(spark, shares, blocks, segment).collect())
        assert got == [(t, *x) for t, x in enumerate(mixing.order(shares, blocks))]


def test_shares_are_in_the_proportion_of_the_weights():
    assert mixing.whole_shares([0.5, 0.25, 0.0]) == [2, 1, 0] and mixing.whole_shares([0.0, 0.0]) == [1, 1] and mixing.whole_shares([3, 2]) == [3, 2]
    weights = [2.0**0.5, 1e-9, 3.0**0.5, 1e6]
    shares = mixing.whole_shares(weights)
    assert sum(shares) <= (1 << mixing.PRECISION) + 4
    assert all(abs(n / sum(shares) - w / sum(weights)) < 2.0**-52 for n, w in zip(shares, weights, strict=True))


def plain_slots(rows, block, weights=None):
    """The whole operator, done a block at a time: each slot is of the source that is due first by exact fractions."""
    from fractions import Fraction

    totals = Counter()
    for _, t, _, s, _ in rows:
        totals[s] += size(t)
    names = sorted(totals, key=lambda s: (-totals[s], s is not None, s or ""))
    mean = sum(weights.values()) / len(weights) if weights else 0
    weight = {s: Fraction(weights.get(s, mean) if weights else float(totals[s]) ** 0.5) for s in names}
    blocks = {s: -(-totals[s] // block) for s in names}
    # When the target of each source has had each number of blocks: shares of what time remains, source by source.
    begin, had, when = Fraction(0), dict.fromkeys(names, Fraction(0)), {s: [Fraction(0)] for s in names}
    live = set(names)
    while live:
        pace = {s: weight[s] / sum(weight[k] for k in live) for s in live}
        step = min((len(when[s]) - had[s]) / pace[s] for s in live)  # until some target is whole
        begin += step
        for s in live:
            had[s] += step * pace[s]
        for s in [s for s in live if had[s] == len(when[s])]:
            when[s].append(begin)
            if len(when[s]) > blocks[s]:
                live.remove(s)
    out, done = {}, Counter()
    for t in range(sum(blocks.values())):
        due = [(-(-when[s][done[s] + 1] // 1), n, s) for n, s in enumerate(names) if done[s] < blocks[s] and when[s][done[s]] // 1 <= t]
        _, _, s = min(due)
        out[s, done[s]] = t
        done[s] += 1
    return out


def test_mixing(spark):
    rows = cases.rows()
    got = mixing.interleave(cases.frame(spark), block=700).collect()
    assert Counter((r.doc_id, r.source, r["size"], r.text_crc32) for r in got) == Counter((i, s, size(t), crc(t)) for i, t, _, s, _ in rows)
    slots = plain_slots(rows, 700)
    by = defaultdict(list)
    for r in got:
        assert r.block == r.start // 700 and slots[r.source, r.block] == r.slot and r.release <= r.slot < r.deadline
        by[r.source].append((r.start, r["size"]))
    for those in by.values():
        at = 0
        for start, n in sorted(those):
            assert start == at
            at += n
    assert mixing.interleave(cases.empty(spark)).count() == 0
    weights = {"s1": 3.0, "s2": 1.0}
    given, slots = mixing.interleave(cases.frame(spark), weights, block=700).collect(), plain_slots(rows, 700, weights)
    assert len(given) == len(rows) and all(slots[r.source, r.block] == r.slot for r in given)


def test_slots_follow_the_exact_weights(spark):
    """Weights that no thousandths give, over more slots than rounding to them would stand."""
    weights = {"a": 0.70044, "b": 0.29906, "c": 0.0005}
    rows = [(i, "x" * 99, s) for s, n in (("a", 4000), ("b", 1900), ("c", 8)) for i in range(n)]
    got = mixing.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block=100).collect()
    order, had = sorted((r.slot, r.source) for r in got), Counter()
    assert [t for t, _ in order] == list(range(len(rows)))
    for t, s in order[:5500]:  # all sources last
        had[s] += 1
        assert all(abs((t + 1) * w - had[k]) < 1 for k, w in weights.items())


@pytest.mark.parametrize("given", [False, True])
def test_every_source_has_its_own_share(spark, given):
    names = [f"s{k:03}" for k in range(150)]
    blocks = {s: 4 + k % 5 for k, s in enumerate(names)}
    weights = {s: float(1 + k % 7) for k, s in enumerate(names)}
    rows = [(1000 * k + i, "x" * 99, s) for k, s in enumerate(names) for i in range(blocks[s])]
    got = mixing.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights if given else None, block=100).collect()
    slots = sorted((r.slot, r.source) for r in got)
    assert [t for t, _ in slots] == list(range(len(rows))) and all(r.release <= r.slot < r.deadline for r in got)
    share = weights if given else {s: (100 * n) ** 0.5 for s, n in blocks.items()}
    until = int(min(blocks[s] / share[s] for s in names) * sum(share.values()))  # all sources last
    had, total = Counter(), sum(share.values())
    for t, s in slots[:until]:
        had[s] += 1
        assert all(abs((t + 1) * share[k] / total - had[k]) < 1 + 1e-9 for k in names)


def test_mix_keeps_all_rows_in_order(spark):
    docs = cases.frame(spark)
    for name in ("row", "slot", "start", "nth", "cls", "bucket", "block", "_own_size", "_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = mixing.mix(docs, block=700)
    assert out.columns == docs.columns
    got = out.collect()
    whole = lambda r: (r.doc_id, r.text, r.source, r.fp, r.slot, r._own_size)
    assert Counter(map(whole, got)) == Counter(map(whole, docs.collect()))
    slot = defaultdict(list)
    for r in mixing.interleave(docs, block=700).collect():
        slot[r.doc_id, r.text_crc32].append((r.slot, r.start))
    at = [min(slot[r.doc_id, crc(r.text)]) for r in got if len(slot[r.doc_id, crc(r.text)]) == 1]
    assert at == sorted(at) and len(at) > 50
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_mixing_with_one_id_for_most_rows(spark, tmp_path):
    """A third of all rows share an id and a text, and a third have none: they are dealt out, and every byte is counted once."""
    rows = [(7, "x" * 50, "a")] * 400 + [(None, "y" * 50, "a")] * 400 + [(i, "z" * 50, "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs.write.parquet(path := str(tmp_path / "docs"))
    docs = spark.read.parquet(path)
    got = mixing.interleave(docs, {"a": 2.0, "b": 1.0}, block=100).collect()
    for s in "ab":
        starts = sorted(r.start for r in got if r.source == s)
        assert starts == [51 * k for k in range(len(starts))] and len(starts) == (800 if s == "a" else 400)
    assert Counter(map(tuple, mixing.mix(docs, block=100).collect())) == Counter(rows)


# Language


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    words = {"en": "the and of with that this from house river", "de": "der und die mit dass dieser von haus straße", "es": "el la de con que este desde casa niño"}
    return [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i, lang in enumerate(rng.choice(list(words), n))]


def test_language(spark):
    rows = sentences(300, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    classifier = language.train(docs, language.not_held_out(), sample=60)
    got = {r.doc_id: r for r in language.identify(docs, classifier).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and all(got[i].lang_pred == lang for i, lang in held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    docs = cases.frame(spark)
    classifier = language.train(docs, language.not_held_out())
    out = language.identify(docs, classifier).collect()
    assert Counter((r.doc_id, r.lang_pred == "und") for r in out) == Counter((i, not any(map(str.isalpha, t or ""))) for i, t, *_ in cases.rows())
    assert all(0 <= r.score <= 1 for r in out)
    assert language.identify(cases.empty(spark), None).count() == 0
    assert language.train(cases.empty(spark), language.not_held_out()) is None
    kept = language.keep_identified(docs, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(any(map(str.isalpha, t or "")) for _, t, *_ in cases.rows())


def plain_grams(text):
    """The n-grams of a text as whole strings: letters in lower case, each run of anything else as one blank."""
    t = " " + re.sub(r"[^a-zà-ÿß]+", " ", text.lower()).strip() + " "
    return {t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)}


def test_kernel_expansion_is_the_folded_product():
    """Kernel ridge regression in its dual form, over sets of strings, gives the values of the folded matrix."""
    rows = sentences(90, 3)
    labels = [lang for *_, lang in rows]
    c = language.fit([t for _, t, _ in rows], labels)
    sets = [plain_grams(t) for _, t, _ in rows]
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    gram = np.array([[k(a, b) for b in sets] for a in sets])
    n, count = len(rows), Counter(labels)
    weight = np.array([n / len(count) / count[x] for x in labels])
    system = np.block([[gram + np.diag(language.RIDGE / weight), np.ones((n, 1))], [np.ones((1, n)), -np.full((1, 1), 1e-9)]])
    target = np.array([[1.0 if x == lang else -1.0 for lang in sorted(count)] for x in labels])
    solved = np.linalg.solve(system, np.vstack([target, np.zeros((1, len(count)))]))
    for text in ("the house with niño", "der Fluss, die straße", "el la 12 casa!", "of river dass"):
        want = np.array([k(plain_grams(text), s) for s in sets]) @ solved[:n] + solved[n]
        assert np.abs(c.values([text])[0] - want).max() < 0.02 and c.languages == sorted(count)
    text = "the house with niño"
    assert c.values([text])[0].argmax() == c.languages.index("en")
    for unit in ("ab ", "a   b", "abc", " 1 é"):
        assert (language.presence([unit * 700_000])[0] == language.presence([unit * 9])[0]).all()


def test_language_learns_from_rows_whatever_their_ids(spark):
    """Ids that are null or shared, a language that is one row many times over, and more labels than landmarks."""
    rows = [(None, f"{t} {i}", lang) for i, t, lang in sentences(900, 5)] + [(7, "ala ma kota i psa a kot ma ale", "pl")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    c = language.train(docs, F.lit(True), sample=40)
    assert c.languages == ["de", "en", "es", "pl"]
    many = [(i, " ".join(f"{chr(0x4E00 + 7 * (i % 300) + k)}{chr(0x4E00 + 7 * (i % 300) + 2 * k % 7)}" for k in range(7)), f"l{i % 300:03}") for i in range(1200)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    c = language.train(docs, F.lit(True))
    assert len(c.languages) == 300
    assert np.mean([r.lang_pred == many[r.doc_id][2] for r in language.identify(docs, c).collect()]) > 0.9


# BPE


@pytest.fixture(scope="module")
def encoding():
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, encoding):
    path, pattern, tik = encoding
    out = bpe.decode(bpe.encode(cases.frame(spark), path, pattern), path, pattern).collect()
    want = Counter((i, tuple(tik.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in cases.rows())
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in out) == want
    both = bpe.encode(cases.frame(spark), path, pattern, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both) == want
    assert bpe.decode(bpe.encode(cases.empty(spark), path, pattern), path, pattern).count() == 0


def test_bpe_of_white_space_in_another_vocabulary(tmp_path):
    """Runs of white space may be tokens; texts are cut at spaces only where the pattern cuts them too."""
    import base64
    import itertools

    import regex

    extra = [b"  ", b"\n ", b" \n", b" a", b"   ", b"\t ", b"a ", b" \n "]
    tokens = [bytes([n]) for n in range(256)] + extra
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(n).encode() for n, t in enumerate(tokens)))
    v = bpe.vocabulary(str(path), bpe.BYTE_LEVEL)
    e, plain = bpe.Encoder(v), regex.compile(bpe.BYTE_LEVEL)
    texts = ["".join(t) for n in range(1, 7) for t in itertools.product("a \n\t", repeat=n)] + ["a\x1c \x1c", "a\u3000 \u3000b ", "x \x85 y \x85"]
    ids, counts = e.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        want = [x for piece in plain.findall(text) for x in bpe.merge(v, [piece.encode()])[0]]
        assert ids[at : at + n].tolist() == want, text
        at += n


def test_bpe_of_random_texts(encoding):
    import random

    path, pattern, tik = encoding
    v, rng = bpe.vocabulary(path, pattern), random.Random(4)
    e = bpe.Encoder(v)
    for _ in range(2000):
        t = "".join(rng.choice(" \n\tab1.'²é\xa0\x1c\u3000日😀st") for _ in range(rng.randint(0, 25)))
        assert e.encode([t])[0].tolist() == tik.encode_ordinary(t)
    long = "".join(rng.choice("abcdefgh") for _ in range(4000))
    assert bpe.merge_one(v, long.encode()) == tik.encode_ordinary(long)
    words = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 60))).encode() for _ in range(300)]
    assert bpe.merge_many(v, words) == [bpe.merge_one(v, w) for w in words]


def test_bpe_refuses_foreign_ids(spark, encoding):
    path, pattern, _ = encoding
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), path, pattern).collect()


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    """nodes: key to least id; the least id that links reach."""
    keys, root = list(nodes), {k: k for k in nodes}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a in range(len(keys)):
        for b in range(a):
            if near(keys[a], keys[b]):
                root[find(keys[a])] = find(keys[b])
    least = {}
    for k, i in nodes.items():
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return {k: least[find(k)] for k in nodes}


def test_simhash(spark):
    docs = cases.frame(spark)
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs).collect())
    rows = [(i, plain_fingerprint(t)) for i, t, *_ in cases.rows()]
    nodes = {}
    for i, fp in rows:
        nodes[fp] = i if nodes.get(fp) is None else nodes[fp] if i is None else min(i, nodes[fp])
    named = components(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == Counter((i, fp, named[fp]) for i, fp in rows)
    assert simhash.simhash_components(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [1, 64])
def test_links_join_what_all_pairs_join(spark, hot):
    rng = np.random.default_rng(8)
    centres = rng.integers(-(2**63), 2**63 - 1, 5, dtype=np.int64).tolist()
    fps = set(rng.integers(-(2**63), 2**63 - 1, 200, dtype=np.int64).tolist())
    for c in centres:  # clouds and chains around a few
        at = c
        for _ in range(60):
            flips = [1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 4))]
            at = (at if rng.random() < 0.5 else c) & (2**64 - 1)
            for f in flips:
                at ^= f
            at = at - 2**64 if at >> 63 else at
            fps.add(at)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [(r.u, r.v) for r in simhash.link_fingerprints(df, 2, hot).collect()]
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(0 < far(u, v) <= 2 for u, v in links)
    linked = set(links) | {(v, u) for u, v in links}
    nodes = {x: x for x in fps}
    assert components(nodes, lambda a, b: far(a, b) <= 2) == components(nodes, lambda a, b: (a, b) in linked)


def test_thresholds():
    cost, chosen = simhash.allocate([[0, 5, 50, 500], [0, 1, 10, 100], [0, 9, 90, 900]], 2)
    assert sum(chosen) == 0 and (cost, chosen) == (10, [-1, 1, -1]) or sum(chosen) == 0
    uneven = simhash.allocate([[0, 100, 1000, 10000], [0, 1, 2, 3]], 2)
    assert uneven == (3, [-1, 2])
    sample = np.random.default_rng(1).integers(0, 2, (500, 64)).astype(float)
    sample[:, 1] = sample[:, 0]
    assert any({0, 1} <= set(g) for g in simhash.bit_groups(sample, 3))
    for n in (100, 10**10):
        plan = simhash.plan_probes(sample, n, 2)
        assert sum(len(g) for g, _ in plan) <= 64 and plan


def jaccard(a, b, words=5):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_first_of_each(spark):
    rng = np.random.default_rng(6)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows, near = [], {}
    for g in range(12):
        base = [word() for _ in range(300)]
        rows.append((1000 + 100 * g, " ".join(base)))
        for k in range(1, 6):  # a few words changed: similarities from 0.85 up
            copy = list(base)
            for p in rng.choice(300, 4, replace=False) if k < 5 else ():
                copy[p] = word()
            rows.append((1000 + 100 * g + k, " ".join(copy)))
            near[rows[-1][0]] = rows[-1][1], " ".join(base)
        rows.append((1000 + 100 * g + 50, " ".join(base[:150] + [word() for _ in range(150)])))  # half is new
    assert min(jaccard(*x) for x in near.values()) > 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("fp", F.lit("clash")).withColumn("long", F.lit(2))
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, _ in rows if i % 100 in (0, 50)} <= ids and len(ids) <= 24 + 3


def test_first_of_each_of_odd_rows(spark):
    docs = cases.frame(spark)
    kept = simhash.first_of_each(docs)
    groups = {r.component_id for r in simhash.simhash_components(docs).collect()}
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == docs.columns and {i for i, _ in got} <= groups and max(got.values()) == 1
    assert simhash.first_of_each(cases.empty(spark)).count() == 0


def test_first_of_each_decides_by_row(spark):
    """Ids that several texts share, ids that are not there and repeated rows: no text is lost, and none stays twice."""
    rng = np.random.default_rng(2)
    a, b, c, d, e = (" ".join("w" + str(rng.integers(0, 5000)) for _ in range(120)) for _ in range(5))
    rows = [(3, b, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 5), (None, c, 6), (None, c, 7), (None, d, 8), (None, d, 9), (None, e, 10), (8, e + " end", 11), (None, None, 12), (9, "", 13), (None, " ", 14)]
    for extra in ("id", "crc"):  # names that are used inside
        out = simhash.first_of_each(spark.createDataFrame(rows, f"doc_id long, text string, {extra} int").repartition(3))
        assert out.columns == ["doc_id", "text", extra]
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert got == Counter([(3, b), (5, a), (7, c), (None, d), (8, e + " end"), (9, "")])
    out = simhash.first_of_each(spark.createDataFrame([(None, a, 1)] * 5 + [(1, b, 2)] * 3, "doc_id long, text string, id int"))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(None, a), (1, b)])


@pytest.mark.parametrize("block", [4, 512])
def test_copies_are_those_of_the_exact_similarity(spark, block):
    rng = np.random.default_rng(14)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows = []
    for g in range(60):  # a run of words changed: similarities from 0.7 to 0.85
        base = [word() for _ in range(200)]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            n = int(rng.integers(12, 32))
            rows.append((10 * g + k, " ".join([*base[:100], *(word() for _ in range(n)), *base[100 + n :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    near = lambda a, b: a // 10 == b // 10 and (jaccard(texts[a], texts[b]) >= 0.8 or (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() <= 2)
    want = set(components({i: i for i in texts}, near).values())
    got = {r.doc_id for r in simhash.first_of_each(docs, block=block).collect()}
    assert want <= got


def test_no_copies_just_above_the_similarity_are_lost(spark):
    rng = np.random.default_rng(15)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows, twins = [], []
    for g in range(150):
        base = [word() for _ in range(200)]
        n = int(rng.integers(12, 18))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[:100], *(word() for _ in range(n)), *base[100 + n :]]))]
        if 0.8 <= jaccard(rows[-2][1], rows[-1][1]) < 0.85:
            twins.append(2 * g + 1)
    assert len(twins) > 100
    got = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert not got & set(twins) and {i for i, _ in rows if i % 2 == 0} <= got


def test_chain_in_order_of_ids(spark):
    from tessella.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000)] + [(5000, 5001 + i) for i in range(200)], "u long, v long")
    got = defaultdict(set)
    for r in connected_components(links).collect():
        got[r.root].add(r.node)
    assert sorted(map(len, got.values())) == [2, 201, 301]
    assert connected_components(links.where("u < 0")).count() == 0


def test_queries_have_the_columns_asked_for(spark):
    from tessella.llm.queries import QUERIES

    wanted = {
        "op1_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
        "op4_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"],
        "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    }
    for name, columns in wanted.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.columns == columns, name
        assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op10_simhash"](spark, "/root/testdata/sf0.001").collect():
        assert r.fingerprint == f"{plain_fingerprint(docs[r.doc_id]):016x}"
    for r in QUERIES["op7_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
