"""Integrity of the records beside revisions: metadata, retention boundaries, peers, checkpoints, attachments."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGEST = "^[0-9a-f]{64}$"


def metadata(meta: dict[str, Any]) -> list[str]:
    """The rules that a database's own record breaks: database_uuid, history_epoch, sequence, floor, compaction_epoch."""
    broken = [f"metadata_{k}" for k in ("database_uuid", "history_epoch") if not isinstance(meta.get(k), str) or not meta[k]]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    broken += [f"metadata_{k}" for k in ("sequence", "floor", "compaction_epoch") if not whole(meta.get(k))]
    if not broken and meta["floor"] > meta["sequence"]:
        broken.append("floor_above_sequence")
    return broken


def check(
    spark: SparkSession, meta: dict[str, Any], revisions: DataFrame | None = None, boundaries: DataFrame | None = None, peers: DataFrame | None = None,
    checkpoints: DataFrame | None = None, attachments: DataFrame | None = None, pending: DataFrame | None = None, now_ms: int = 0,
) -> DataFrame:
    """Violations as (rule, subject); none if all is well. Frames that are not given are not looked at.

    boundaries: document_id, minimum_generation, compaction_epoch. peers: peer_id, database_uuid, history_epoch,
    safe_sequence, compaction_epoch, expires_ms (null: never). checkpoints: peer_id, safe_sequence, compaction_epoch,
    history (array of sequences, newest last). attachments: document_id, revision_id, digest, length. pending:
    digest, length, of blobs that no revision has yet. A revision may not lie below its document's boundary unless it
    is a leaf; each rule is a filter, or an anti-join on keys.
    """
    found = [spark.createDataFrame([(r, None) for r in metadata(meta)], "rule string, subject string")]
    sequence, floor, epoch = (meta.get(k) if isinstance(meta.get(k), int) else 0 for k in ("sequence", "floor", "compaction_epoch"))

    def add(rule: str, df: DataFrame, *subject: str) -> None:
        found.append(df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *(F.col(c).cast("string") for c in subject)).alias("subject")))

    if boundaries is not None:
        bad = F.col("document_id").isNull() | (F.coalesce("minimum_generation", F.lit(0)) < 1) | ~F.coalesce("compaction_epoch", F.lit(-1)).between(0, epoch)
        add("boundary", boundaries.where(bad), "document_id")
        if revisions is not None:
            parents = revisions.where("parent_revision is not null").select("document_id", F.col("parent_revision").alias("revision_id")).distinct()
            inner = revisions.join(parents, ["document_id", "revision_id"], "left_semi")
            low = boundaries.groupBy("document_id").agg(F.max("minimum_generation").alias("low"))
            add("revision_below_boundary", inner.join(low, "document_id").where(F.substring_index("revision_id", "-", 1).try_cast("int") < F.col("low")), "document_id", "revision_id")
    if peers is not None:
        add("peer_database", peers.where(~F.col("database_uuid").eqNullSafe(F.lit(meta.get("database_uuid")))), "peer_id")
        add("peer_epoch", peers.where(~F.col("history_epoch").eqNullSafe(F.lit(meta.get("history_epoch")))), "peer_id")
        add("peer_ahead", peers.where(F.col("safe_sequence").isNull() | (F.col("safe_sequence") > sequence) | (F.col("safe_sequence") < 0)), "peer_id")
        add("peer_compaction", peers.where(~F.coalesce("compaction_epoch", F.lit(-1)).between(0, epoch)), "peer_id")
        live = peers.where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms))
        add("peer_below_floor", live.where(F.col("safe_sequence") < floor), "peer_id")
    if checkpoints is not None:
        add("checkpoint_ahead", checkpoints.where(F.col("safe_sequence").isNull() | (F.col("safe_sequence") > sequence)), "peer_id")
        add("checkpoint_compaction", checkpoints.where(~F.coalesce("compaction_epoch", F.lit(-1)).between(0, epoch)), "peer_id")
        rises = F.expr("forall(sequence(1, greatest(1, size(history) - 1)), n -> size(history) < 2 or history[n - 1] < history[n])")
        add("checkpoint_history", checkpoints.where(~rises), "peer_id")
    if attachments is not None:
        add("attachment_fields", attachments.where(~F.coalesce(F.col("digest").rlike(_DIGEST), F.lit(False)) | (F.coalesce("length", F.lit(-1)) < 0)), "document_id", "revision_id")
        if revisions is not None:
            add("attachment_without_revision", attachments.join(revisions.select("document_id", "revision_id"), ["document_id", "revision_id"], "left_anti"), "document_id", "revision_id")
    if pending is not None:
        add("pending_blob", pending.where(~F.coalesce(F.col("digest").rlike(_DIGEST), F.lit(False)) | (F.coalesce("length", F.lit(-1)) < 0)), "digest")
    return reduce(DataFrame.unionByName, found)
