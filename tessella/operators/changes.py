"""The changes feed, replication by sets, checkpoints."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.errors import EngineError, invalid
from tessella.operators import revisions as rev
from tessella.sources.checkpoints import durable
from tessella.sources.versions import Versions

#: Changes of a page at most.
MOST = 500


def since(changes: DataFrame, sequence: int, limit: int | None = None, floor: int = 0, visible: int | None = None) -> DataFrame:
    """Changes after a sequence, in order, up to a visible one; history below the floor is gone."""
    if sequence < floor:
        raise EngineError("history_truncated", "the feed no longer reaches back so far", floor=floor)
    df = changes.where(F.col("sequence") > sequence)
    if visible is not None:
        df = df.where(F.col("sequence") <= visible)
    df = df.orderBy("sequence")
    return df if limit is None else df.limit(limit)


def read(changes: DataFrame, sequence: int, limit: int, floor: int = 0) -> dict[str, Any]:
    """A page of at most MOST: results, last_sequence, has_more."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 0 < limit <= MOST:
        raise invalid(f"limit must be 1 to {MOST}")
    held = since(changes, sequence, limit + 1, floor).collect()
    return {"results": held[:limit], "last_sequence": held[:limit][-1]["sequence"] if held else sequence, "has_more": len(held) > limit}


def latest(changes: DataFrame) -> DataFrame:
    """Each document's last change."""
    return changes.groupBy("document_id").agg(F.max_by(F.struct(*(F.col(c) for c in changes.columns if c != "document_id")), "sequence").alias("c")).select("document_id", "c.*")


def with_bodies(changes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Changes with the body of the winning revision."""
    bodies = revisions.select("document_id", F.col("revision_id").alias("winning_revision"), "body")
    return changes.join(bodies, ["document_id", "winning_revision"], "left")


def replicate(source: DataFrame, target: DataFrame, changes: DataFrame, checkpoint: int, floor: int = 0) -> tuple[DataFrame, int]:
    """One pass from a checkpoint: what the target's documents, changed since, lack of the source's revisions
    is added. Returns the target's new revisions and the new checkpoint; a second pass adds nothing."""
    new = since(changes, checkpoint, floor=floor)
    touched = new.select("document_id").distinct()
    wanted = source.join(touched, "document_id", "left_semi")
    lacking = _lacking(wanted, target)
    last = new.agg(F.max("sequence").alias("m")).first().m
    return rev.merge(target, lacking.select(*target.columns)), checkpoint if last is None else int(last)


def _lacking(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The whole rows that `revisions.missing` names, by one join; it names none without an id."""
    return wanted.where("revision_id is not null").join(held.select("document_id", "revision_id"), ["document_id", "revision_id"], "left_anti")


def reconcile(ours: list[dict[str, Any]], theirs: list[dict[str, Any]]) -> int:
    """The greatest sequence that both checkpoint histories (session_id, sequence) have; 0 if none."""
    mine = {(x["session_id"], x["sequence"]) for x in ours}
    return max((x["sequence"] for x in theirs if (x["session_id"], x["sequence"]) in mine), default=0)


class Records:
    """Small records with compare-and-set, as checkpoints need, each in numbered files that all machines see: the
    next number is written if it is free, so of two writers one fails, and a crash leaves the value before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, namespace: str, key: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{namespace}/{key}", "none")

    def get(self, namespace: str, key: str) -> tuple[int, Any]:
        """The record's version (0: none) and value."""
        state = self._at(namespace, key).state()
        return state["version"], state.get("value")

    def put(self, namespace: str, key: str, value: Any, version: int) -> int:
        """Sets the value if the record still has this version; gives the new one."""
        if self.get(namespace, key)[0] != version:
            raise EngineError("checkpoint_conflict", "the record has changed", key=key)
        self._at(namespace, key).point({"version": version + 1, "layers": [], "value": value})
        return version + 1


def follow(stream: DataFrame, source: Callable[[], DataFrame], target: str, records: Records, name: str, checkpoint: str, forever: bool = False) -> StreamingQuery:
    """Continuous replication: for each batch of a stream of changes (sequence, document_id), what the target (a
    Parquet folder of revisions) lacks of the source's revisions of those documents is appended, and then the
    record (replication, name) moves to the batch's last sequence. A batch that runs again finds nothing lacking, so
    a crash between the two loses nothing and adds nothing twice. Runs until it has caught up, or on and on."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.agg(F.max("sequence")).first()[0]
        if last is None:
            return
        held = source()
        wanted = held.join(df.select("document_id").distinct(), "document_id", "left_semi")
        session = df.sparkSession
        at = session._jvm.org.apache.hadoop.fs.Path(target)
        there = at.getFileSystem(session._jsc.hadoopConfiguration()).exists(at)
        have = session.read.schema(held.schema).parquet(target) if there else session.createDataFrame([], held.schema)
        lacking = durable(_lacking(wanted, have).select(*held.columns))
        rev.merge(have.join(df.select("document_id").distinct(), "document_id", "left_semi"), lacking)  # refuses parents that neither has
        lacking.write.mode("append").parquet(target)
        version, value = records.get("replication", name)
        if value is None or value["sequence"] < last:
            records.put("replication", name, {"sequence": int(last), "session_id": name}, version)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer if forever else writer.trigger(availableNow=True)).start()
