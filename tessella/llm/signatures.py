"""Candidates that share a bucket, thinned by signatures and joined without listing pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable
from tessella.llm.vectors import BLOCK, groups

#: One row in so many is counted to see which buckets are large. No result depends on it.
COUNTED = 64
_ODD = np.int64(0x5555555555555555)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits signatures differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def codes_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their codes of two bits signatures differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> 1) & _ODD).sum(axis=-1, dtype=np.int16)


def most_apart(places: int, chance: float, lost: float) -> int:
    """In how many places at most signatures differ, but for a chance of `lost`, if each differs with `chance`."""
    left = 1.0
    for d in range(places + 1):
        left -= math.comb(places, d) * chance**d * (1 - chance) ** (places - d)
        if left <= lost:
            return d
    return places


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that links join to each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def alike(signs: np.ndarray, most: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] = bits_apart, own: np.ndarray | None = None) -> np.ndarray:
    """For each row of signatures, the least that is joined with it by pairs that differ in at most `most` places.

    own: compare only rows with different ones."""
    n = len(signs)
    root = np.arange(n)
    for at in range(0, n, 256):
        near = apart(signs[at : at + 256, None, :], signs[None, :, :]) <= most
        if own is not None:
            near &= own[at : at + 256, None] != own[None, :]
        a, b = np.nonzero(near)
        keep = root[a + at] != root[b]  # what is joined already needs no link
        root = roots(n, np.concatenate([a[keep] + at, np.arange(n)]), np.concatenate([b[keep], root]))
    return root


def near_links(met: DataFrame, most: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] = bits_apart, block: int = BLOCK) -> DataFrame:
    """met (key, cid and then the signature, all bigint) to links (u, v) of cids: rows of one key whose signatures differ
    in at most `most` places are joined by these links.

    A row goes through one shuffle, and a group gives a link a row at most. Keys of more than `block` rows, which
    copies make, are seen in a count of one row in COUNTED, and cut by hash into blocks, each pair of which is a
    group of its own; any that escape it are compared a few rows at a time where they are.
    """
    signs = met.columns[2:]
    large = met.where(F.pmod(F.xxhash64("cid"), F.lit(COUNTED)) == 0).groupBy("key").count().where(F.col("count") * COUNTED > block)
    large = durable(large.select("key", F.ceil(F.col("count") * COUNTED / block).cast("int").alias("blocks")))

    def compare(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for group in groups(batches, keys):
            if group.num_rows < 2:
                continue
            cid = np.asarray(group.column(keys))
            own = np.asarray(group.column(group.num_columns - 1)) if keys > 1 and group.column(1)[0] != group.column(2)[0] else None
            root = alike(np.column_stack([np.asarray(group.column(keys + 1 + n)) for n in range(len(signs))]), most, apart, own)
            some = np.flatnonzero(cid[root] != cid)
            us.append(cid[some])
            vs.append(cid[root[some]])
            if len(us) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], names=["u", "v"])
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], names=["u", "v"])

    if large.isEmpty():
        dealt = met.repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(lambda batches: compare(batches, 1), "u bigint, v bigint").distinct()
    met = met.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cid", *signs, "own")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(lambda batches: compare(batches, 3), "u bigint, v bigint").distinct()
