"""Reading and writing document sets, changes and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.binding import Documents


def table(spark: SparkSession, path: str, id: str, json: tuple[str, ...] = (), null: bool = False, version: str | None = None) -> Documents:
    """A Parquet table as documents; its columns are the fields, and filters on them reach the scan."""
    return Documents(spark.read.parquet(path), id, json=json, null=null, version=version)


def json_lines(spark: SparkSession, path: str, id: str = "id") -> Documents:
    """A file of JSON documents, one a line, with the id under a key; lines that are no JSON, or have a key
    twice, are left out (`rejected` has them)."""
    df = spark.read.text(path).withColumn("body", F.try_parse_json("value")).where(F.is_variant_null("body") | F.col("body").isNotNull())
    return Documents(df.select(F.try_variant_get("body", f"$.{id}", "string").alias("id"), "body"), "id", body="body")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The lines that json_lines leaves out."""
    return spark.read.text(path).where(F.try_parse_json("value").isNull())


def variants(df: DataFrame, id: str, body: str, revision: str | None = None, version: str | None = None) -> Documents:
    """A frame whose body column is JSON text, as documents."""
    return Documents(df.withColumn("body", F.parse_json(body)), id, body="body", revision=revision, version=version)


def write_json(docs: Documents, path: str) -> None:
    """Documents as JSON lines."""
    body = F.to_json(docs.body) if docs.body else F.to_json(F.struct(*docs.df.columns))
    docs.df.select(body.alias("value")).write.mode("errorifexists").text(path)


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of files: path, digest (SHA-256, what they are stored under), length, content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"), "length", "content")


def unreferenced(blobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Blobs (digest) that no manifest row refers to."""
    return blobs.join(manifests.select("digest").distinct(), "digest", "left_anti")


def damaged(blobs: DataFrame) -> DataFrame:
    """Blobs whose content is not what their digest says."""
    return blobs.where(F.sha2("content", 256) != F.col("digest"))
