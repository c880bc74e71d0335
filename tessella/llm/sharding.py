"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import dealt, durable, text_of


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All rows of docs (doc_id, text) in `shards` contiguous runs of near-equal bytes.

    A row weighs the UTF-8 bytes of its text plus one (a null text: one). The small projection
    (id, size, checksum) is range-partitioned in the order doc_id (nulls first), checksum, size, and
    checkpointed, so a partition is a fixed run of the global order. A total for each partition (a row
    a partition) is turned into prefix sums and sent back by a broadcast of as many rows as there are
    partitions; a row whose middle byte lies in the k-th of `shards` equal parts of all bytes goes to
    shard k. So a shard differs from the target by less than one row at either end, whatever the sizes.

    Returns doc_id, size, text_crc32 (unsigned, null as empty), shard, slot (gapless from 0 within a
    shard, in the global order), start (bytes before the row). Rows equal in all of id, size and
    checksum are interchangeable. An empty table gives an empty result; a row larger than a target
    leaves shards empty. Only doc_id and text are read, so other columns cannot clash.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = text_of()
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # The random-looking last key splits runs of equal rows over partitions.
    small = durable(small.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())))
    count = dealt(docs)
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "tie"]
    ranged = durable(small.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.count("*").over(inside))
        .join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * start + size) * {shards}) div (2 * all_bytes)")).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "row", "start")
    )
    placed = durable(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), "start")
