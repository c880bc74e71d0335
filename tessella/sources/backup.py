"""Manifests of folders: which files there are, how long, with which digest; and whether that still holds."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file (relative to the folder), length, digest (SHA-256) of every file below a folder, each read by one task;
    names that begin with _ or . are none of its data, and files without a byte hold none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/")
    return files.select(F.substring(at, len(_plain(base)) + 1, 1 << 20).alias("file"), "length", F.sha2("content", 256).alias("digest"))


def _plain(path: str) -> str:
    """With one slash after the scheme, however many there are."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"


def summary(found: DataFrame) -> dict[str, Any]:
    """files, bytes, and a fingerprint of all names and digests in any order."""
    row = found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(F.xxhash64("file", "length", "digest")), F.lit(0)).alias("fingerprint")).first()
    return row.asDict()


def verify(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    """(file, problem) for every file that is missing, unexpected or changed since the manifest `kept` was made."""
    now = manifest(spark, path).select("file", F.col("length").alias("l"), F.col("digest").alias("d"))
    both = kept.select("file", "length", "digest").join(now, "file", "full_outer")
    problem = F.when(F.col("d").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when((F.col("l") != F.col("length")) | (F.col("d") != F.col("digest")), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")
