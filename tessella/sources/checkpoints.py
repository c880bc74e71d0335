"""Reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.errors import EngineError


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder that spark.checkpoint.dir names; rows keep their
    partitions, and a lost executor loses nothing. Where the session names no folder, one is made if driver and
    executors are one process, as in tests; on a cluster that is an error, as no folder would be known to be
    shared. Spark removes a checkpoint that nothing refers to any more if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            master = context.master
            if master != "local" and not master.startswith("local["):
                raise EngineError("invalid_request", "on a cluster, spark.checkpoint.dir has to name a folder that all machines share")
            named = "file://" + tempfile.mkdtemp(prefix="tessella-checkpoint-")
            _at_exit(spark, named)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def _at_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the same shared folder; what is there when the driver ends is removed."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4()}"
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    _at_exit(spark, path)
    return path
