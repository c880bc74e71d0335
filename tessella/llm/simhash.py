"""SimHash near-duplicates found by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable, fresh, text_of
from tessella.llm.components import connected_components
from tessella.llm.signatures import codes_apart, most_apart, near_links
from tessella.llm.vectors import groups

BITS = 64
#: Fingerprints at most that the bit groups and thresholds are estimated from.
SAMPLE = 8192
#: Fingerprints that own a bucket beyond which no pairs are formed in it: a member's own 65 midpoints are then as cheap.
HOT = 64
_CHUNK = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case; as bytes, so that only ASCII counts for case and white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(found: list[bytes], words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's words as a signed 64-bit integer; 0 if there are none."""
    if not found:
        return 0
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    last = len(found) - words + 1
    for at in range(0, last, _CHUNK):
        end = min(last, at + _CHUNK)
        rolls = zip(*(found[at + k : end + k] for k in range(words)), strict=True)
        h = np.fromiter((digest(b" ".join(s), seed) for s in rolls), np.uint64, end - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > last, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text) to (doc_id, fp bigint), over whole texts, in Arrow batches without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fp = np.fromiter((fingerprint(words_of(x.as_py()), words, seed) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of near-equal width, each grown from correlated bits.

    sample: 0/1 rows. A group starts from the free bit with the largest total correlation and takes the
    free bit most correlated with its members until it is full.
    """
    spread = sample.std(axis=0)
    centred = (sample - sample.mean(axis=0)) / np.where(spread == 0, 1, spread)
    correlation = np.abs(centred.T @ centred) / max(1, len(sample))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: (correlation[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            group.append(best := max(free, key=lambda b: (correlation[b, group].sum(), -b)))
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Least-cost thresholds by dynamic programming.

    costs[i][t + 1] is what threshold t (-1: group i is not probed) costs. The thresholds sum to
    radius - groups + 1, the least sum with which two fingerprints within `radius` bits meet in some
    group within its threshold.
    """
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, extra in enumerate(row, start=-1):
                now = (cost + extra, [*chosen, t])
                if spent + t not in step or now < step[spent + t]:
                    step[spent + t] = now
        best = step
    return best[radius - len(costs) + 1]


def plan_probes(sample: np.ndarray, total: int, radius: int) -> list[tuple[list[int], int]]:
    """Bit groups and their thresholds with the least estimated work for `total` fingerprints.

    For every number of groups up to radius + 1, costs are probes (values within the threshold of a
    member's own) plus candidates, estimated from how many sampled pairs agree on the group, and from
    uniform bits where the sample is too small to show any. So groups get wider, and thresholds larger, as
    fingerprints get more, before their buckets get hot: with even bits, the mean bucket of any plan for up
    to 10^11 fingerprints holds fewer than HOT by their own value.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, radius + 2):
        groups = bit_groups(sample, parts)
        costs = []
        for group in groups:
            width = len(group)
            values = sample[:, group].astype(np.uint64) @ (1 << np.arange(width, dtype=np.uint64))
            _, counts = np.unique(values, return_counts=True)
            agree = max(float((counts * (counts - 1.0)).sum()) / max(1.0, len(sample) * (len(sample) - 1.0)), 2.0**-width)
            row, probes = [0.0], 0.0
            for t in range(radius + 1):
                probes += float(np.prod([(width - k) / (k + 1) for k in range(t)]))
                row.append(total * probes * (1 + total * agree / 2))
            costs.append(row)
        cost, thresholds = allocate(costs, radius)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of up to `most` of the bits."""
    masks = [0]
    for _ in range(most):
        masks = sorted({m ^ (1 << b) for m in masks for b in bits} | set(masks))
    return masks


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_fingerprints(distinct: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """Links (u, v) that join all of distinct (fp bigint) lying within `radius` (at most 2) bits.

    Fingerprints within the radius share a bucket: the value of some bit group, within the group's
    threshold. In a bucket that at most `hot` fingerprints own (by their value itself), each member meets those,
    and pairs are verified. Members of larger buckets, which a cluster of near copies makes, instead send their 64 one-bit neighbours and themselves to one aggregate:
    two of them are within two bits exactly if they share one of those, and any that share one are, so
    each is linked with the least that shares it. That is exact, 65 rows a member, and never a pair; the
    links joined are then those of all pairs, though not each pair is listed.
    """
    if not 1 <= radius <= 2:
        raise ValueError("radius must be 1 or 2")
    distinct = distinct.select("fp")
    total = distinct.count()
    if total < 2:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("u != v")
    drawn = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    sample = np.unpackbits(drawn.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    plan = plan_probes(sample, total, radius)

    probes = F.array(*[
        F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseXOR(F.lit(_signed(m))).bitwiseAND(F.lit(_signed(sum(1 << b for b in group)))).alias("key"), F.lit(m != 0).alias("moved"))
        for k, (group, most) in enumerate(plan)
        for m in _flips(group, most)
    ])
    members = distinct.select("fp", F.inline(probes))
    sizes = members.groupBy("part", "key").agg(F.count("*").alias("n"), F.sum((~F.col("moved")).cast("long")).alias("owners")).where("n > 1 and owners > 0").drop("n")
    members = durable(members.join(sizes, ["part", "key"]))

    cold = members.where(F.col("owners") <= hot)
    own, others = cold.where("not moved").select("part", "key", F.col("fp").alias("u")), cold.select("part", "key", F.col("fp").alias("v"), "moved")
    # Between two that lie in the bucket by their own value, one order will do.
    pairs = own.join(others, ["part", "key"]).where((F.col("u") != F.col("v")) & (F.col("moved") | (F.col("u") < F.col("v"))) & (_near("u", "v") <= radius)).select("u", "v")

    large = members.where(F.col("owners") > hot).select("fp").distinct()
    reach = [0, *(1 << b for b in range(BITS))] if radius == 2 else [0]
    if radius == 2:
        middles = large.select(F.col("fp").alias("v"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(m))) for m in reach])).alias("middle"))
        stars = middles.groupBy("middle").agg(F.min("v").alias("u"), F.max("v").alias("w"), F.collect_set("v").alias("all"))
        stars = stars.where("u != w").select("u", F.explode("all").alias("v"))  # at most 65 share a middle
    else:
        ends = large.select(F.col("fp").alias("v"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)])).alias("u"))
        stars = ends.join(large.select(F.col("fp").alias("u")), "u", "left_semi").select("u", "v")
    return pairs.union(stars.where("u != v").select("u", "v")).distinct()


def simhash_components(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text).

    fp is the SimHash of the lower-cased (A-Z) words of the whole text in shingles of `words`, repeats
    included; a shorter text is one shingle, a text that is null or has no word has fingerprint 0, which
    links like any other. Rows with one fingerprint are one node, however many they are; nodes within
    `radius` bits are linked, and component_id is the smallest doc_id that links reach (nulls do not
    count; it is null if there is no other). Repeated rows stay. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, words, seed))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = grouped(nodes, connected_components(link_fingerprints(nodes, radius)))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def grouped(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, least) and (node, root) to (fp, component_id): the least of all that share a root."""
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def _forest(near: np.ndarray) -> np.ndarray:
    """The least row that links join to each row of a square of booleans."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] < 0:
            reached = np.zeros(len(near), bool)
            reached[start] = True
            edge = np.array([start])
            while len(edge):
                new = near[edge].any(axis=0) & ~reached
                reached |= new
                edge = np.flatnonzero(new)
            root[reached] = start
    return root


#: Least hashes that a band of `band_keys` joins; the chance at most that a pair just at the similarity meets in no band;
#: classes of a candidate component that are compared in one group at most.
ROWS, LOST, TOGETHER = 4, 1e-6, 512
#: Chance at most that the signatures of a pair just at the similarity differ in too many places.
THINNED = 1e-8


def shingle_set(found: list[bytes], words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text's words, each mixed from those of its words in order; fewer
    words are one shingle."""
    words = min(words, len(found)) or 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, found or [b""]), np.uint64, max(1, len(found)))
    last = len(h) - words + 1
    out = np.full(last, words, np.uint64)
    for k in range(words):
        out = (out ^ h[k : last + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_count(similarity: float, miss: float) -> int:
    """Bands with which a pair just at the Jaccard similarity meets in none with a chance of `miss` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity**ROWS)))


def band_keys(shingles: np.ndarray, bands: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, of the least of ROWS hashes over the set; and as a signature two bits of each least hash,
    32 to a number."""
    rng = np.random.default_rng(seed)
    mask, odd = rng.integers(0, 2**63, (2, bands * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = (shingles[at : at + 4096] ^ mask) * odd
        least = np.minimum(least, (x ^ x >> np.uint64(32)).min(axis=1))
    keys = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), n) for n, x in enumerate(least.reshape(bands, ROWS))), np.uint64, bands).view(np.int64)
    codes = np.zeros(-(-len(least) // 32) * 32, np.uint64)
    codes[: len(least)] = least & np.uint64(3)
    return keys, (codes.reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have at least the Jaccard similarity, exactly."""
    size = np.array([len(x) for x in sets], np.float64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1  # what only one set has is in no intersection
    row, column = np.repeat(np.arange(len(sets)), size.astype(int))[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        some = slice(*np.searchsorted(column, [at, at + 4096]))
        has = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - at)), np.float32)
        has[row[some], column[some] - at] = 1
        both += has @ has.T
    return both / (size[:, None] + size[None, :] - both) >= similarity


def verified(members: DataFrame, similarity: float, words: int, block: int = TOGETHER) -> DataFrame:
    """Links (u, v) of fingerprints, from members (root, cid, fp, text, blocks) of candidate components.

    All classes of a component are compared by their whole shingle sets, and a link is kept only for an exact
    Jaccard similarity that is high enough. A component beyond `block` is cut by hash and each pair of blocks
    is a group. A group gives a link for each class at most, to the least that links of the group join it with.
    """
    keys = ["root", "lo", "hi"]
    met = members.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = met.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "fp", "text")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            cid = np.asarray(group.column(4))
            once = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]]))  # repeated rows
            own, fp, texts = np.asarray(group.column(3))[once], np.asarray(group.column(5))[once], group.column(6)
            if len(once) < 2 or (group.column(1)[0] != group.column(2)[0] and len(np.unique(own)) < 2):
                continue
            near = alike([shingle_set(words_of(texts[int(n)].as_py()), words) for n in once], similarity)
            if group.column(1)[0] != group.column(2)[0]:
                near &= own[:, None] != own[None, :]
            root = fp[_forest(near)]
            yield pa.RecordBatch.from_arrays([pa.array(fp[root != fp]), pa.array(root[root != fp])], names=["u", "v"])

    return dealt.mapInArrow(compare, "u bigint, v bigint").distinct()


def first_of_each(docs: DataFrame, similarity: float = 0.8, words: int = 5, near_words: int = 3, radius: int = 2, miss: float = LOST, block: int = TOGETHER) -> DataFrame:
    """docs with one document of each group of near-duplicates.

    Documents are linked if their fingerprints over shingles of `near_words` lie within `radius` bits
    (`link_fingerprints`), or if their sets of shingles of `words` have the Jaccard similarity, exactly.
    Candidates for the second are texts that agree in a band of least hashes, and whose signatures of two bits of
    each least hash are near enough (`near_links`), so that texts that share passages alone do not chain; a pair
    just at the similarity is missed with a chance of `miss` and THINNED at most. A component of candidates is
    compared as a whole, from the texts (`verified`).

    What goes is decided by row, that is by id and text, and of each group one row stays: the one of least
    doc_id (rows without an id come last), then of least text checksum; of rows that agree in id and text, any
    one. So an id that several texts share takes none of them with it, and a text that nothing is near always
    stays. Null texts, empty ones and those without a word are one group, as they are to the fingerprints. All
    columns of the row are kept, whatever their names; an empty table gives an empty result.
    """
    bands = band_count(similarity, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, cid, keys, signs = [], [], [], []
            for x in batch.column(1):
                found = words_of(x.as_py())
                fp.append(fingerprint(found, near_words))
                shingles = shingle_set(found, words)
                cid.append(xxhash.xxh64_intdigest(shingles.tobytes(), fp[-1] & 0xFFFFFFFFFFFFFFFF))
                own, sign = band_keys(shingles, bands)
                keys.append(own)
                signs.append(sign)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in x])]).astype(np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (keys, signs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64()), pa.array(np.array(cid, np.uint64).view(np.int64)), *lists], names=["doc_id", "crc", "fp", "cid", "keys", "signs"])

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(text_of()).alias("crc"))
    prints = durable(texts.mapInArrow(run, f"doc_id {kind}, crc bigint, fp bigint, cid bigint, keys array<bigint>, signs array<bigint>"))
    # One row, by id and text, stands for all of a class.
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")).alias("pick")
    classes = durable(prints.groupBy("cid", "fp").agg(pick, F.first("keys").alias("keys"), F.first("signs").alias("signs")))
    nodes = durable(classes.groupBy("fp").agg(F.min("pick").alias("least")))

    held = classes.select("cid", F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.min("cid").alias("u"), F.max("cid").alias("w")).where("u != w").select("key")
    signs = [F.col("signs")[n].alias(f"s{n}") for n in range(-(-bands * ROWS // 32))]
    met = durable(held.join(shared, "key").join(classes.select("cid", *signs), "cid").select("key", "cid", *(f"s{n}" for n in range(len(signs)))))
    apart = most_apart(bands * ROWS, (1 - similarity) * 3 / 4, THINNED)
    candidates = durable(connected_components(near_links(met, apart, codes_apart)))
    sizes = candidates.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wanted = candidates.join(sizes, "root").join(classes.select(F.col("cid").alias("node"), "fp", "pick"), "node")
    wanted = wanted.select("root", F.col("node").alias("cid"), "fp", "blocks", F.col("pick.doc_id").alias("_id"), F.col("pick.crc").alias("_crc"))
    members = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc"))).select("root", "cid", "fp", "text", "blocks")

    links = durable(link_fingerprints(nodes.select("fp"), radius).union(verified(members, similarity, words, block)))
    stays = grouped(nodes, connected_components(links)).select("component_id.doc_id", "component_id.crc").distinct()
    again = prints.groupBy("doc_id", "crc").count().where("count > 1").select("doc_id", "crc")
    id_, crc = fresh(docs, "id", "crc")
    stays = durable(stays.join(again.withColumn("many", F.lit(True)), stays["doc_id"].eqNullSafe(again["doc_id"]) & (stays["crc"] == again["crc"]), "left").select(stays["doc_id"].alias(id_), stays["crc"].alias(crc), F.coalesce("many", F.lit(False)).alias("many")))

    def rows(which: DataFrame) -> DataFrame:
        return docs.join(which, docs["doc_id"].eqNullSafe(which[id_]) & (F.xxhash64(text_of()) == which[crc]), "left_semi")

    once = rows(stays.where("not many").select(id_, crc))
    repeated = stays.where("many").select(id_, crc)
    if repeated.isEmpty():
        return once
    # Combined before the shuffle, so that a row repeated without end is one row for each task.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = rows(repeated).groupBy(F.col("doc_id").alias("i"), F.col("text").alias("t")).agg(F.first(whole).alias("row"))
    return once.unionByName(one.select("row.*"))
