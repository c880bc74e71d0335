"""What the operators share: reading tables, durable checkpoints, broadcasts and columns by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.checkpoints import durable

__all__ = ["dealt", "durable", "fresh", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def dealt(df: DataFrame) -> int:
    """Partitions for state gathered from the whole input: as many as a shuffle has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column's name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
