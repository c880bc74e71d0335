"""Near-duplicate embeddings by random-hyperplane signs, exact cosines and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable
from tessella.llm.components import connected_components
from tessella.llm.signatures import most_apart, near_links, roots
from tessella.llm.vectors import BLOCK, groups, matrix, unit, valid

#: Chance at most that a pair exactly at the threshold meets in no table; vectors of a label a bucket should have.
MISS, WANTED = 1e-6, 256
#: Bits of a signature, besides the tables'; chance at most that a pair at the threshold differs in too many of them.
SIGN, LOST = 128, 1e-9


def tables_for(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table, and tables, for labels of up to `rows` vectors."""
    bits = max(4, min(24, round(math.log2(max(2, rows / WANTED)))))
    alike = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - alike))) if alike < 1 else 1


def link_classes(classes: DataFrame, dim: int, threshold: float, bits: int, tables: int, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """classes (cid, label, n, embedding) of one dimension to (cid, links, root): parts of how many other
    vectors a class links with, and a class that it is joined with, summed and joined by the caller.

    Every class has a code of hyperplane signs in each table, and a signature of further ones. Classes of one label
    that share a table's code, and whose signatures may be those of a pair at the threshold, are joined into
    components (`near_links`), without the vectors: a row of a table is a key, an id and two numbers. Then each vector is sent to its component, once: all
    pairs of one are tried, by products of matrices, so a near pair that meets in any table counts exactly once. A
    component beyond `block` classes is cut into blocks by hash, and each pair of blocks is a group of its own.
    Pairs stay inside: a group returns two numbers for each class.
    """
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits + SIGN))
    power = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            above = matrix(batch.column(2)) @ planes > 0
            codes = (above[:, SIGN:].reshape(-1, tables, bits) @ power).astype(np.int32)
            signs = np.packbits(above[:, :SIGN], axis=1, bitorder="little").view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, *map(pa.array, signs.T.copy())], names=["cid", "lab", "codes", "s1", "s2"])

    rows = classes.select("cid", F.xxhash64("label").alias("lab"), "embedding")
    signed = durable(rows.mapInArrow(sign, "cid bigint, lab bigint, codes array<int>, s1 bigint, s2 bigint"))
    met = signed.select("cid", "s1", "s2", "lab", F.posexplode("codes").alias("tab", "code")).select(F.xxhash64("lab", "tab", "code").alias("key"), "cid", "s1", "s2")
    apart = most_apart(SIGN, math.acos(min(1.0, threshold)) / math.pi, LOST)
    near = durable(connected_components(near_links(met, apart, block=block)))
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    met = near.join(sizes, "root").withColumnRenamed("node", "cid").join(classes.select("cid", F.xxhash64("label").alias("lab"), "n", "embedding"), "cid")
    met = met.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    order = ["root", "lab", "lo", "hi"]
    dealt = met.select("root", "lab", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "n", "embedding")
    dealt = dealt.repartition(*order).sortWithinPartitions(*order)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            cid, n = np.asarray(group.column(5)), np.asarray(group.column(6))
            v = unit(matrix(group.column(7)))
            close = np.triu(v @ v.T >= threshold, 1)
            if group.column(2)[0] != group.column(3)[0]:
                side = np.asarray(group.column(4))
                close &= side[:, None] != side[None, :]
            a, b = np.nonzero(close)
            if len(a):
                links = np.bincount(a, n[b], len(cid)) + np.bincount(b, n[a], len(cid))
                root, some = roots(len(cid), a, b), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some].astype(np.int64)), pa.array(cid[root[some]])], names=["cid", "links", "root"])

    return dealt.mapInArrow(pairs, "cid bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is at
    least the threshold. n_links counts the other rows linked with; component_id is the smallest vec_id
    that links reach, its own included; kept is whether it is the row's own. Vectors that do not take part
    (`valid`, or without a label) link with nothing; those of different lengths do not link. Equal
    vectors of a label are one class with a count, so copies cost nothing further; classes are linked by
    `link_classes`, with codes as long as the largest label asks for and as many tables as keep the
    chance of a miss at the threshold under MISS. Repeated rows, also of one vec_id, count as vectors of
    their own; a null vec_id is never the smallest. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    good = valid("embedding") & F.col("label").isNotNull()
    classes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    largest = {r.dim: r.most for r in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most")).orderBy("dim").collect()}
    parts = None
    for dim, most in largest.items():
        bits, tables = tables_for(most, threshold)
        part = link_classes(classes.where(F.col("dim") == dim), dim, threshold, bits, tables, block)
        parts = part if parts is None else parts.union(part)
    if parts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = durable(parts)
    roots = connected_components(parts.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = classes.select("label", "embedding", "least", "n", "cid").join(parts.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    named = named.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    smallest = named.where("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    named = named.join(smallest, "root", "left").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")
    )
    joined = rows.where(good).join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
