"""Distributed connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable


def _rank(name: str):
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links of bigints to (node, root): one root for all nodes that links join.

    Each round hooks every node to its neighbour of least hashed rank (an aggregate, combined before
    the shuffle), renames the links by that and drops those inside a group. Hashed ranks make chains in
    id order shrink by a constant factor as well, so rounds are logarithmic; the maps of the rounds are
    then composed from the last, which is the smallest, to the first. Nodes without links do not
    appear; null ends and links of a node to itself count as none. A hub costs no task: its links are
    combined before the shuffle, and the renaming is an equi-join that adaptive execution splits.
    Every round is a reliable checkpoint; links never reach the driver.
    """
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v")
    links = durable(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    maps = []
    while True:
        hooked = links.groupBy("u").agg(F.min(_rank("v")).alias("best"))
        hooked = durable(hooked.select(F.col("u").alias("node"), F.least(F.col("best"), _rank("u"))["id"].alias("parent")))
        maps.append(hooked)
        left = hooked.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = hooked.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        links = links.join(left, "u").join(right, "v").where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        links = durable(links.distinct())
        if links.isEmpty():
            break
    roots = maps.pop().select("node", F.col("parent").alias("root"))
    for earlier in reversed(maps):
        later = roots.select(F.col("node").alias("parent"), F.col("root").alias("further"))
        roots = earlier.join(later, "parent", "left").select("node", F.coalesce("further", "parent").alias("root"))
    return roots
