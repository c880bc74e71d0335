"""Retrieval metrics over ranked results and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval(results: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg, recall, average_precision at k.

    results: query_id, doc_id, rank (from 1); judgements: query_id, doc_id, grade (0: not relevant).
    Queries without a relevant document score 0; those without results as well.
    """
    graded = judgements.where("grade > 0").select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"))
    hits = results.where(F.col("rank") <= k).join(graded, ["query_id", "doc_id"])
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(order))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    found = hits.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.count("*").alias("n"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = graded.withColumn("place", F.row_number().over(best)).groupBy("query_id").agg(
        F.sum(F.when(F.col("place") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("idcg"), F.count("*").alias("relevant")
    )
    every = judgements.select("query_id").union(results.select("query_id")).distinct()
    joined = every.join(ideal, "query_id", "left").join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "query_id", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("n") / F.col("relevant")).alias("recall"),
        zero(F.col("ap") / F.col("relevant")).alias("average_precision"),
    )
