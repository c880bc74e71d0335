"""Revision trees: leaves, winners, conflicts, writes, transfer, retention, checks.

revisions: document_id, revision_id ('generation-digest'), parent_revision, history_id, deleted, and if
needed body (JSON text). All are equi-joins and aggregates by document; nothing walks trees row by row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import EngineError, invalid
from tessella.functions.canonical import canonical, decode, revision_id
from tessella.sources.checkpoints import durable

BULK = 500
#: Revisions of a document whose chains one task walks at most, and rows of a block of documents.
WALK, BLOCK = 200_000, 50_000


def generation(c: str = "revision_id") -> Column:
    return F.substring_index(c, "-", 1).try_cast("int")


def leaves(revisions: DataFrame) -> DataFrame:
    """Revisions that are nobody's parent."""
    parents = revisions.where("parent_revision is not null").select("document_id", F.col("parent_revision").alias("revision_id")).distinct()
    return revisions.join(parents, ["document_id", "revision_id"], "left_anti")


def _rank(c: Column | None = None) -> Column:
    return F.struct((~F.col("deleted")).cast("int").alias("live"), generation().alias("generation"), F.substring_index("revision_id", "-", -1).alias("digest"))


def winners(revisions: DataFrame) -> DataFrame:
    """A document's winner: of its leaves, a live one first, then the highest generation, then digest."""
    rows = leaves(revisions)
    whole = F.struct(*(F.col(c) for c in rows.columns if c != "document_id"))
    return rows.groupBy("document_id").agg(F.max_by(whole, _rank()).alias("w")).select("document_id", "w.*")


def conflicts(revisions: DataFrame) -> DataFrame:
    """Live leaves besides the winner, sorted: one aggregate over live leaves, as the winner is live if any leaf is."""
    live = leaves(revisions).where("not deleted").groupBy("document_id")
    found = live.agg(F.max_by("revision_id", _rank()).alias("winner"), F.array_sort(F.collect_set("revision_id")).alias("all"))
    return found.where("size(all) > 1").select("document_id", "winner", F.array_remove("all", F.col("winner")).alias("conflicts"))


def documents(revisions: DataFrame) -> DataFrame:
    """The winners that are not deleted: what queries see."""
    return winners(revisions).where("not deleted")


def read(revisions: DataFrame, document_id: str, revision_id: str | None = None) -> Any:
    """Point read: a revision, or the winner if none is named and it is not deleted; only the document's rows are read."""
    own = revisions.where(F.col("document_id") == document_id)
    row = (winners(own) if revision_id is None else own.where(F.col("revision_id") == revision_id)).first()
    if row is None and revision_id is not None and not own.isEmpty():
        raise EngineError("revision_not_found", "the document has no such revision", id=document_id, revision=revision_id)
    if row is None or (revision_id is None and row.deleted):
        raise EngineError("document_not_found", "no such document", id=document_id)
    return row


def identify(df: DataFrame) -> DataFrame:
    """revision_id of rows (document_id, history_id, parent_revision, deleted, body, attachments as JSON text),
    from canonical JSON; invalid bodies fail the job. Used on writes alone, in Arrow batches."""

    def ids(document: pd.Series, history: pd.Series, parent: pd.Series, deleted: pd.Series, body: pd.Series, attachments: pd.Series) -> pd.Series:
        rows = zip(document, history, parent, deleted, body, attachments, strict=True)
        return pd.Series([revision_id(d, h, None if pd.isna(p) else p, bool(x), None if b is None else decode(b), decode(a) if a else {}) for d, h, p, x, b, a in rows])

    return df.withColumn("revision_id", F.pandas_udf(ids, "string")("document_id", "history_id", "parent_revision", "deleted", "body", "attachments"))


def canonical_text(c: str) -> Column:
    """JSON text in canonical form."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else canonical(decode(t)))

    return F.pandas_udf(run, "string")(c)


def write(revisions: DataFrame, operations: list[dict[str, Any]], atomic: bool = True) -> tuple[DataFrame, list[dict[str, Any]]]:
    """revisions with a batch of at most BULK operations, all or none, later ones seeing earlier ones.

    An operation has id, body (null or absent with delete: true), and if_revision for a document that
    exists. Without it, a document that has none yet gets a root; a replay of an identical root changes
    nothing; anything else is revision_conflict. Of the stored rows only those of the batch's documents
    are read.
    """
    if not 0 < len(operations) <= BULK:
        raise invalid(f"1 to {BULK} operations")
    ids = sorted({op["id"] for op in operations})
    state = {r.document_id: r.asDict(recursive=True) for r in winners(revisions.where(F.col("document_id").isin(*ids))).collect()}
    new, results = [], []
    for op in operations:
        deleted, body, held = bool(op.get("delete")), op.get("body"), state.get(op["id"])
        text = None if deleted else canonical(body)
        wanted = op.get("if_revision")
        try:
            if held is None:
                if wanted is not None or deleted:
                    raise EngineError("revision_conflict" if wanted else "document_not_found", "no such document", id=op["id"])
                history, parent = op.get("history_id") or str(uuid.uuid4()), None
            elif wanted is None:
                if not deleted and held["parent_revision"] is None and not held["deleted"] and held.get("body") is not None and canonical(decode(held["body"])) == text:
                    results.append({"id": op["id"], "revision": held["revision_id"], "replayed": True})
                    continue
                raise EngineError("revision_conflict", "the document exists", id=op["id"])
            elif wanted != held["revision_id"]:
                raise EngineError("revision_conflict", "the revision is not the winner", id=op["id"])
            elif held["deleted"]:
                history, parent = op.get("history_id") or str(uuid.uuid4()), None
            else:
                history, parent = held["history_id"], held["revision_id"]
        except EngineError as e:
            if atomic:
                raise
            results.append({"id": op["id"], "error": e.code})
            continue
        row = {"document_id": op["id"], "history_id": history, "parent_revision": parent, "deleted": deleted, "body": text}
        row["revision_id"] = revision_id(op["id"], history, parent, deleted, None if deleted else body)
        new.append(row)
        state[op["id"]] = row
        results.append({"id": op["id"], "revision": row["revision_id"], "replayed": False})
    if not new:
        return revisions, results
    return revisions.unionByName(_rows_of(revisions, new)), results


def _rows_of(revisions: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """Rows in the shape of revisions; what they lack is null."""
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in revisions.schema.fields])
    return revisions.sparkSession.createDataFrame([tuple(r.get(f.name) for f in shape.fields) for r in rows], shape)


def resolve(revisions: DataFrame, document_id: str, expected: list[str], keep: str, body: Any = None) -> DataFrame:
    """Ends a conflict: the live leaves must be just those expected; `keep` gets a child with the body (its
    own, if none), and the others get tombstones."""
    live = {r.revision_id: r.asDict() for r in leaves(revisions.where(F.col("document_id") == document_id)).where("not deleted").collect()}
    if set(live) != set(expected) or keep not in live:
        raise EngineError("revision_conflict", "the live leaves are others", live=sorted(live))
    rows = []
    for leaf, row in sorted(live.items()):
        text = None if leaf != keep else row["body"] if body is None else canonical(body)
        child = row | {"parent_revision": leaf, "deleted": leaf != keep, "body": text}
        child["revision_id"] = revision_id(document_id, row["history_id"], leaf, leaf != keep, None if text is None else json.loads(text))
        rows.append(child)
    return revisions.unionByName(_rows_of(revisions, rows))


def missing(wanted: DataFrame, revisions: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """(document_id, revision_id) asked for that are not stored, nor below a retained boundary
    (document_id, minimum_generation)."""
    gone = wanted.select("document_id", "revision_id").distinct().join(revisions.select("document_id", "revision_id"), ["document_id", "revision_id"], "left_anti")
    if boundaries is not None:
        low = boundaries.groupBy("document_id").agg(F.max("minimum_generation").alias("_low"))
        gone = gone.join(low, "document_id", "left").where(F.col("_low").isNull() | (generation() >= F.col("_low"))).drop("_low")
    return gone


def merge(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The union of two revision sets; again, it changes nothing. Parents that neither has are refused: the check
    reads ids alone and needs no doubles removed, as a parent is there once or more often."""
    both = ours.unionByName(theirs)
    stored = both.select("document_id", F.col("revision_id").alias("parent_revision"))
    asked = both.where("parent_revision is not null").select("document_id", "parent_revision")
    if not asked.join(stored, ["document_id", "parent_revision"], "left_anti").isEmpty():
        raise EngineError("integrity_violation", "an imported revision has no parent")
    return both.dropDuplicates(["document_id", "revision_id"])


def ancestors(revisions: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(document_id, leaf, revision_id, depth) from each start (document_id, revision_id) to its root, or at most
    `most` steps.

    Documents of up to WALK revisions come together once, by document, and their chains are walked in Arrow batches,
    all of a block a step at a time. Larger ones are spread over many tasks, as there keys are revisions (`_doubled`).
    """
    large = revisions.groupBy("document_id").agg(F.count("*").alias("_n")).where(F.col("_n") > WALK).select("document_id")
    rest = [] if large.isEmpty() else [_doubled(*(x.join(large, "document_id", "left_semi") for x in (revisions, starts)), most)]
    if rest:
        revisions, starts = (x.join(large, "document_id", "left_anti") for x in (revisions, starts))
    own = revisions.select("document_id", "revision_id", "parent_revision").join(starts.select("document_id").distinct(), "document_id", "left_semi")
    asked = starts.select("document_id", "revision_id", F.lit(None).cast("string").alias("parent_revision"), F.lit(True).alias("start"))
    # By a number: if own and asked are in partitions by document_id already, Spark leaves a repartition by that out, and
    # adaptive execution then joins partitions of the one without those of the other.
    rows = own.withColumn("start", F.lit(False)).unionByName(asked).repartition(F.xxhash64("document_id")).sortWithinPartitions("document_id")
    walked = rows.mapInArrow(lambda batches: _walk(batches, most), "document_id string, leaf string, revision_id string, depth int")
    return reduce(DataFrame.unionByName, rest, walked)


def _walk(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """document_id, leaf, revision_id, depth of rows (document_id, revision_id, parent_revision, start) in order of
    documents, by blocks of whole documents."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        names = batch.column(0).to_pylist()
        cut = len(names)  # what is before belongs to documents that end in this batch
        while cut and names[cut - 1] == names[-1]:
            cut -= 1
        if count >= BLOCK and names[0] != last:
            yield from _climb(pa.Table.from_batches(held), most)
            held, count = [], 0
        last = names[-1]
        if cut and count + cut >= BLOCK:
            yield from _climb(pa.Table.from_batches([*held, batch[:cut]]), most)
            held, count = [batch[cut:]], len(names) - cut
        else:
            held.append(batch)
            count += len(names)
    if held:
        yield from _climb(pa.Table.from_batches(held), most)


def _climb(rows: pa.Table, most: int | None) -> Iterator[pa.RecordBatch]:
    """_walk, of whole documents: (document, revision) is one number, and a link leads from one to its parent's."""
    rows = rows.combine_chunks()
    documents = pa.chunked_array(rows["document_id"].chunks, pa.string()).combine_chunks().dictionary_encode("encode")
    named = pa.concat_arrays([c.cast(pa.string()) for n in ("revision_id", "parent_revision") for c in rows[n].chunks]).dictionary_encode()
    name = np.asarray(pc.fill_null(named.indices, -1)).astype(np.int64)
    document, width = np.asarray(documents.indices).astype(np.int64), len(named.dictionary) + 1  # the last for null
    own, up = name[: len(rows)], name[len(rows) :]
    start = np.asarray(rows["start"])
    real = pc.is_valid(documents.dictionary).to_numpy(zero_copy_only=False)[document]
    key, above = document * width + own % width, document * width + up
    stored = real & ~start & (own >= 0)
    linked = stored & (up >= 0) & np.isin(above, key[stored])
    links = np.unique(np.stack([key[linked], above[linked]], 1), axis=0)
    child, parent = links[:, 0].copy(), links[:, 1].copy()
    at = leaf = key[start]
    found, size, depth = [(leaf, at, 0)], len(at), 0
    labels = pa.concat_arrays([named.dictionary, pa.nulls(1, pa.string())])

    def out() -> pa.RecordBatch:
        leaves, ats = (np.concatenate([f[n] for f in found]) for n in (0, 1))
        depths = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
        columns = [documents.dictionary.take(pa.array(ats // width)), labels.take(pa.array(leaves % width)), labels.take(pa.array(ats % width)), pa.array(depths, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["document_id", "leaf", "revision_id", "depth"])

    while len(at) and (most is None or depth < most):
        low, high = np.searchsorted(child, at, "left"), np.searchsorted(child, at, "right")
        n = high - low
        at = parent[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        leaf, depth = np.repeat(leaf, n), depth + 1
        if size + len(at) > BLOCK and size:
            yield out()
            found, size = [], 0
        if len(at):
            found.append((leaf, at, depth))
            size += len(at)
    if size:
        yield out()


def _doubled(revisions: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    """`ancestors` by doubling: each round knows, of every revision of the starts' documents, the ancestor so many
    steps away, adds those of what is found, and squares the steps. So a chain of n generations takes log n rounds of
    equi-joins, each a checkpoint; a document that holds most revisions is spread over many tasks, as keys are
    revisions."""
    own = revisions.select("document_id", "revision_id", "parent_revision").join(starts.select("document_id").distinct(), "document_id", "left_semi")
    stored = own.select("document_id", F.col("revision_id").alias("parent_revision"))
    jump = durable(own.where("parent_revision is not null").join(stored, ["document_id", "parent_revision"], "left_semi").select("document_id", "revision_id", F.col("parent_revision").alias("up")).distinct())
    found, steps = starts.select("document_id", F.col("revision_id").alias("leaf"), "revision_id", F.lit(0).alias("depth")), 1
    while (most is None or steps <= most) and not jump.isEmpty():
        more = found.join(jump, ["document_id", "revision_id"]).select("document_id", "leaf", F.col("up").alias("revision_id"), (F.col("depth") + steps).alias("depth"))
        found = durable(found.unionByName(more if most is None else more.where(F.col("depth") <= most)))
        steps *= 2
        if most is None or steps <= most:
            next_ = jump.select("document_id", F.col("revision_id").alias("up"), F.col("up").alias("further"))
            jump = durable(jump.join(next_, ["document_id", "up"]).select("document_id", "revision_id", F.col("further").alias("up")))
    return found


def chains(revisions: DataFrame, wanted: DataFrame, after: str | None = None, limit: int | None = None) -> DataFrame:
    """The chains of wanted (document_id, revision_id), root first; a page of documents by id, if asked."""
    if after is not None:
        wanted = wanted.where(F.col("document_id") > after)
    if limit is not None:
        wanted = wanted.join(wanted.select("document_id").distinct().orderBy("document_id").limit(limit), "document_id", "left_semi")
    walked = ancestors(revisions, wanted)
    return walked.join(revisions, ["document_id", "revision_id"]).orderBy("document_id", "leaf", F.desc("depth"))


def compaction(revisions: DataFrame, latest: DataFrame, floor: int, depth: int) -> DataFrame:
    """document_id, revision_id, reason of revisions to remove: of documents whose latest change (latest:
    document_id, sequence) is not above the floor, all beyond the winner's last depth + 1 generations; all of
    a document whose leaves are all deleted (reason retired). A revision's place in the winning chain is
    the winner's generation less its own, as a chain loses one each step."""
    settled = latest.groupBy("document_id").agg(F.max("sequence").alias("sequence")).where(F.col("sequence") <= floor).select("document_id")
    rows = revisions.select("document_id", "revision_id", "parent_revision", "deleted")
    rows = durable(rows.join(settled, "document_id", "left_semi"))  # read by each of the steps below
    won = winners(rows)
    dead = won.where("deleted").select("document_id")  # a live leaf would have won
    kept = ancestors(rows, won.select("document_id", "revision_id"), depth).select("document_id", "revision_id").distinct()
    alive = rows.join(dead, "document_id", "left_anti").join(kept, ["document_id", "revision_id"], "left_anti").select("document_id", "revision_id", F.lit("superseded").alias("reason"))
    return alive.unionByName(rows.join(dead, "document_id", "left_semi").select("document_id", "revision_id", F.lit("retired").alias("reason")))


def frontier(peers: DataFrame, current: int, floor: int, now_ms: int, enabled: bool = True) -> dict[str, int | bool]:
    """The sequence up to which history may go: the least safe one of active peers (safe_sequence,
    expires_ms; null: never), never below the floor; without peers, the current one."""
    if not enabled:
        return {"candidate_floor": floor, "floor_advanced": False, "active_peers": 0}
    row = peers.where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms)).agg(F.min("safe_sequence").alias("low"), F.count("*").alias("n")).first()
    candidate = max(floor, current if row.low is None else row.low)
    return {"candidate_floor": candidate, "floor_advanced": candidate > floor, "active_peers": row.n}


def compact(revisions: DataFrame, changes: DataFrame, peers: DataFrame, current: int, floor: int, depth: int, now_ms: int, enabled: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """One maintenance pass: the revisions and changes (sequence, document_id) that stay, and the new floor of history,
    up to which all active peers have read (`frontier`). Changes at or below the floor go, and the revisions that
    `compaction` names for it; without an advance, nothing does."""
    edge = frontier(peers, current, floor, now_ms, enabled)
    if not edge["floor_advanced"]:
        return revisions, changes, floor
    low = edge["candidate_floor"]
    gone = compaction(revisions, changes.select("document_id", "sequence"), low, depth)
    return revisions.join(gone, ["document_id", "revision_id"], "left_anti").select(*revisions.columns), changes.where(F.col("sequence") > low), low


def check(revisions: DataFrame, changes: DataFrame | None = None, floor: int = 0) -> DataFrame:
    """Violations as (rule, document_id, revision_id); none if all is well."""

    def found(rule: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), "document_id", "revision_id")

    stored = revisions.select("document_id", "revision_id", "parent_revision", "history_id", "deleted")
    key = ["document_id", "revision_id"]
    parent = stored.select("document_id", F.col("revision_id").alias("parent_revision"), F.col("history_id").alias("_history"))
    kids = stored.where("parent_revision is not null")
    joined = kids.join(parent, ["document_id", "parent_revision"], "left")
    rules = [
        found("identity", stored.where(~F.col("revision_id").rlike("^[1-9][0-9]*-[0-9a-f]{64}$"))),
        found("generation", kids.where(generation() != generation("parent_revision") + 1)),
        found("root_generation", stored.where(F.col("parent_revision").isNull() & (generation() != 1))),
        found("dangling_parent", joined.where("_history is null")),
        found("history", joined.where("_history is not null and _history <> history_id")),
        found("duplicate", stored.groupBy(*key).count().where("count > 1")),
    ]
    if "body" in revisions.columns:
        rules += [found("deleted_body", revisions.where("deleted and body is not null")), found("live_without_body", revisions.where("not deleted and body is null"))]
    if "is_leaf" in revisions.columns:
        own = leaves(revisions).select(*key, F.lit(True).alias("_leaf"))
        rules.append(found("leaf_marker", revisions.join(own, key, "left").where(F.coalesce("_leaf", F.lit(False)) != F.col("is_leaf"))))
    if changes is not None:
        renamed = changes.select("sequence", "document_id", F.col("winning_revision").alias("revision_id"), "winning_deleted")
        rules += [
            found("change_below_floor", renamed.where(F.col("sequence") <= floor)),
            found("change_without_revision", renamed.join(stored.select(*key), key, "left_anti")),
            found("duplicate_sequence", renamed.join(renamed.groupBy("sequence").count().where("count > 1"), "sequence", "left_semi")),
        ]
        last = renamed.groupBy("document_id").agg(F.max_by(F.struct("revision_id", "winning_deleted"), "sequence").alias("c"))
        won = winners(stored).select("document_id", F.col("revision_id").alias("_won"), F.col("deleted").alias("_deleted"))
        stale = last.join(won, "document_id").where((F.col("c.revision_id") != F.col("_won")) | (F.col("c.winning_deleted") != F.col("_deleted")))
        rules.append(found("winner", stale.select("document_id", F.col("c.revision_id").alias("revision_id"))))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
