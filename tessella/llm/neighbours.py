"""Approximate nearest neighbours by a forest of random-projection trees with one priority queue."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import durable
from tessella.llm.vectors import BLOCK, groups, matrix, valid

#: Vectors at most that the forest is fitted on, and their bytes as doubles; trees; rows a leaf should have (a 256th of the
#: table, if less); of a sample, rows a leaf must have.
SAMPLE, BYTES, TREES, LEAF, LEAST = 32_768, 1 << 25, 2, 512, 8
#: Sampled vectors that recall is measured on, and the mean that it must reach there.
TRIALS, RECALL = 256, 0.94
#: Rows that a query visits at least, if there are so many: too few queries average out too little.
FLOOR = 2048
#: Blocks of rows that a block of queries is as large as: a row is sent once for each of those.
ASKS = 4
#: Best matches held in a task before they are cut to each query's own best.
_HELD = 1 << 20


class Tree:
    """Inner nodes are hyperplanes (left: not above); a child below zero is leaf -1 - child."""

    def __init__(self, rows: np.ndarray, leaf: int, rng: np.random.Generator):
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.top = self._grow(rows, leaf, rng)
        self.matrix = np.array(self.planes).reshape(-1, rows.shape[1])
        self.bounds = np.array(self.cuts)

    def _grow(self, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            # Of a few random directions, the one along which the rows spread most.
            tried = rng.standard_normal((4, rows.shape[1]))
            tried /= np.linalg.norm(tried, axis=1, keepdims=True)
            at = rows @ tried.T
            best = int(at.std(axis=0).argmax())
            cut = float(np.median(at[:, best]))
            above = at[:, best] > cut
            if 0 < above.sum() < len(rows):
                me = len(self.planes)
                self.planes.append(tried[best])
                self.cuts.append(cut)
                self.children.append([0, 0])
                self.children[me] = [self._grow(rows[~above], leaf, rng), self._grow(rows[above], leaf, rng)]
                return me
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.full(len(rows), self.top)
        if self.top < 0:
            return -1 - node
        above = (rows @ self.matrix.T > self.bounds).astype(int)
        children = np.array(self.children)
        while (inner := np.flatnonzero(node >= 0)).size:
            node[inner] = children[node[inner], above[inner, node[inner]]]
        return -1 - node


def visits(forest: list[Tree], query: np.ndarray, sizes: list[np.ndarray], budget: float) -> list[tuple[int, int]]:
    """The (tree, leaf) that one query visits: all trees share a queue, by the sum of the squares of how far the
    query lies on the wrong side of the hyperplanes on the way; until the leaves hold `budget` rows."""
    margin = [t.matrix @ query - t.bounds for t in forest]
    queue = [(0.0, n, t.top) for n, t in enumerate(forest)]
    heapq.heapify(queue)
    out, total = [], 0
    while queue and total < budget:
        far, n, node = heapq.heappop(queue)
        while node >= 0:
            m = margin[n][node]
            left, right = forest[n].children[node]
            near, other = (right, left) if m > 0 else (left, right)
            heapq.heappush(queue, (far + m * m, n, other))
            node = near
        out.append((n, -1 - node))
        total += int(sizes[n][-1 - node])
    return out


def enough(forest: list[Tree], rows: np.ndarray, asked: np.ndarray, asks: np.ndarray, k: int, recall: float) -> float:
    """The rows that queries must visit, as a share of all, for the recall on average.

    rows: lifted sample; asks: those of its rows that ask, as `asked`. Their true k best of the sample are found by
    brute force; the best that a query has found grows with the leaves it visits, in the order of its walk.
    """
    leaves = [t.leaf_of(rows) for t in forest]
    sizes = [np.bincount(at, minlength=t.leaves) for t, at in zip(forest, leaves, strict=True)]
    product = asked @ rows.T
    product[np.arange(len(asks)), asks] = -np.inf
    k = min(k, len(rows) - 1)
    needed = []
    for query, true in zip(asked, np.argpartition(-product, k - 1, axis=1)[:, :k], strict=True):
        walk = visits(forest, query, sizes, math.inf)
        before, total = {}, 0  # a leaf is visited if what was visited before it is less than the budget
        for place in walk:
            before[place] = total
            total += int(sizes[place[0]][place[1]])
        needed += [min(before[n, int(at[x])] for n, at in enumerate(leaves)) for x in true]
    return float(np.sort(needed)[math.ceil(recall * len(needed)) - 1] + 1) / len(rows)


def best_of(query: np.ndarray, qid: np.ndarray, rows: np.ndarray, rid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of each query's k best rows, itself excluded, ties to smaller ids."""
    product = query @ rows.T
    product[qid[:, None] == rid[None, :]] = -np.inf
    if len(rid) > k:
        least = np.partition(product, len(rid) - k, axis=1)[:, len(rid) - k]
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0)))
        a, b = np.nonzero((product >= (least - slack)[:, None]) & np.isfinite(product))
    else:
        a, b = np.nonzero(np.isfinite(product))
    score = np.empty(len(a))
    for at in range(0, len(a), 1 << 15):  # again, in one fixed order of summing, so equal vectors tie
        score[at : at + (1 << 15)] = (query[a[at : at + (1 << 15)]] * rows[b[at : at + (1 << 15)]]).sum(axis=1)
    return cut(qid[a], rid[b], score, k)


def cut(q: np.ndarray, r: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best distinct rows."""
    order = np.lexsort((r, -score, q))
    q, r, score = q[order], r[order], score[order]
    again = np.zeros(len(q), bool)
    again[1:] = (q[1:] == q[:-1]) & (r[1:] == r[:-1])  # equal scores lie together
    q, r, score = q[~again], r[~again], score[~again]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], r[keep], score[keep]


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = 0.0, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows with the largest inner products found.

    vectors: (vec_id, embedding); queries are the rows that is_query holds for, candidates all rows but
    those with the query's own vec_id. Vectors that do not take part (`valid`), or without a vec_id, are neither.
    Vectors of each length are searched among themselves, as others have no inner product with them. For inner
    products, every vector gets one more component that brings it to the largest norm there is (queries: zero),
    so nearness by angle is that by product.

    The forest is fitted on at most `sample` vectors and BYTES, those of least hash, and every row is put into a
    leaf of each tree. A query walks all trees with one priority queue until the leaves visited hold as many
    rows, as a share of the table, as TRIALS vectors of the sample, held against brute force, need for a recall
    of RECALL (or `share`, if that is more; and FLOOR rows). Data of low inner dimension need little; vectors that fill their
    dimension evenly need most of the table. Leaves that lie together are sent to a task as one group, with each
    query that visits any of them once, and meet there leaf by leaf in matrix products. Groups with many rows or
    queries are cut into blocks, so equal vectors, however many, are spread. A task keeps its queries' k best;
    scores are recomputed on the original vectors before the k best of all are ranked, nearest first, ties to the
    smaller vec_id. Leaf sizes, at most sample / LEAST for a tree, are all that reaches the driver besides the
    sample. Rows with one vec_id are one candidate if their vectors agree. No rows, or one, give none; other
    columns are not read.
    """
    rows = vectors.where(valid("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding", is_query.alias("asks"))
    shape = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + cast(x as double) * x)")).alias("square"))
    out = None
    for some in shape.orderBy("dim").collect():
        part = _search(rows.where(F.size("embedding") == some.dim), some.dim, some.n, some.square, k, share, trees, leaf, sample, seed, block)
        out = part if out is None else out.unionAll(part)
    return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if out is None else out


def _search(rows: DataFrame, dim: int, n: int, square: float, k: int, share: float, trees: int, leaf: int, sample: int, seed: int, block: int) -> DataFrame:
    """The search among rows (vec_id, embedding, asks) of one length."""
    spark, longest = rows.sparkSession, square * (1 + 1e-12)

    def lifted(x: np.ndarray, asks: bool) -> np.ndarray:
        more = np.zeros(len(x)) if asks else np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))
        return np.column_stack([x, more]) / math.sqrt(longest)

    sample = max(2, min(sample, BYTES // (8 * dim)))
    drawn = matrix(rows.select("embedding", "vec_id").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks())
    fit = lifted(drawn, False)
    small = max(LEAST, math.ceil(min(leaf, max(LEAST, n / 256)) * len(fit) / n))
    rng = np.random.default_rng(seed)
    forest = [Tree(fit, small, rng) for _ in range(trees)]
    if len(drawn) > 1:
        # Vectors of least hash are in random order.
        asks = np.arange(min(TRIALS, len(drawn)))
        share = max(share, enough(forest, fit, lifted(drawn[asks], True), asks, k, RECALL))
    context = spark.sparkContext
    shared = context.broadcast(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = lifted(matrix(batch.column(1)), False)
                found = np.column_stack([t.leaf_of(x) for t in shared.value]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * trees), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "embedding", "asks", "leaves"])

    kind = dict(rows.dtypes)["embedding"]
    indexed = durable(rows.mapInArrow(index, f"vec_id bigint, embedding {kind}, asks boolean, leaves array<int>"))
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r.tree][r.leaf] = r["count"]
    # Leaves in the order of the tree, as many as hold about `block` rows; a larger one is a group of its own.
    group_of, count = [], 0
    for held in sizes:
        numbers, total = np.zeros(len(held), np.int64), 0
        for n_, size in enumerate(held.tolist()):
            if n_ and total + size > block:
                count, total = count + 1, 0
            numbers[n_], total = count, total + size
        group_of.append(numbers)
        count += 1
    sized, grouped, budget = context.broadcast(sizes), context.broadcast(group_of), max(4.0 * k, FLOOR, share * n)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = pa.list_(pa.struct([("grp", pa.int64()), ("leaves", pa.list_(pa.int32()))]))
        for batch in batches:
            if batch.num_rows:
                plans = []
                for q in lifted(matrix(batch.column(1)), True):
                    by: dict[int, list[int]] = {}
                    for t, x in visits(shared.value, q, sized.value, budget):
                        by.setdefault(int(grouped.value[t][x]), []).append(x)
                    plans.append([{"grp": g, "leaves": sorted(those)} for g, those in by.items()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plans, where)], names=["vec_id", "embedding", "places"])

    asked = durable(indexed.where("asks").select("vec_id", "embedding").mapInArrow(ask, f"vec_id bigint, embedding {kind}, places array<struct<grp:bigint,leaves:array<int>>>"))
    demand = {r.grp: r["count"] for r in asked.select(F.inline("places")).groupBy("grp").count().collect()}  # a row a group at most
    held = np.zeros(count, np.int64)
    for numbers, size in zip(group_of, sizes, strict=True):
        np.add.at(held, numbers, size)
    plan = spark.createDataFrame([(g, max(1, math.ceil(int(held[g]) / block)), math.ceil(asks / (ASKS * block))) for g, asks in demand.items()] or [(-1, 1, 1)], "grp bigint, row_blocks int, ask_blocks int")
    place = spark.createDataFrame([(t, x, int(g)) for t, numbers in enumerate(group_of) for x, g in enumerate(numbers)], "tree int, leaf int, grp bigint")
    mine = indexed.select(F.posexplode("leaves").alias("tree", "leaf"), "vec_id", "embedding").join(F.broadcast(place.join(plan, "grp")), ["tree", "leaf"])
    mine = mine.select(
        "grp", F.pmod(F.xxhash64("vec_id"), "row_blocks").cast("int").alias("rb"), F.explode(F.expr("sequence(0, ask_blocks - 1)")).alias("ab"), F.lit(0).alias("side"), "vec_id", "embedding", F.array("leaf").alias("leaves")
    )
    asking = asked.select(F.inline("places"), "vec_id", "embedding").join(F.broadcast(plan), "grp").select(
        "grp", F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("rb"), F.pmod(F.xxhash64("vec_id"), "ask_blocks").cast("int").alias("ab"), F.lit(1).alias("side"), "vec_id", "embedding", "leaves"
    )
    keys = ["grp", "rb", "ab"]
    dealt = mine.union(asking).repartition(*keys).sortWithinPartitions(*keys, "side", "leaves", "vec_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = ["query_id", "vec_id", "score"]
        count = 0
        for group in groups(batches, 3):
            side, vid = np.asarray(group.column(3)), np.asarray(group.column(4))
            first = int((side == 0).sum())
            if not 0 < first < len(vid):
                continue
            x = matrix(group.column(5))
            leaf_of = np.asarray(group.column(6).slice(0, first).flatten())  # one each, and in order
            lists = group.column(6).slice(first)
            who, asks = np.repeat(np.arange(first, len(vid)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
            for at, end in _runs(leaf_of):
                those = who[asks == leaf_of[at]]
                for q in range(0, len(those), 256):
                    some = those[q : q + 256]
                    kept.append(best_of(x[some], vid[some], x[at:end], vid[at:end], k))
                    count += len(kept[-1][0])
            if count > _HELD:
                kept = [cut(*(np.concatenate(z) for z in zip(*kept, strict=True)), k)]
                count = len(kept[0][0])
                if 2 * count > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in kept[0]], names=names)
                    kept, count = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in cut(*(np.concatenate(z) for z in zip(*kept, strict=True)), k)], names=names)

    found = dealt.mapInArrow(meet, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    ends = [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip([0, *ends[:-1]], ends, strict=True))
