"""Live queries: which documents are members of a selector's result, and how changes move them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tessella.errors import EngineError, invalid
from tessella.operators import query
from tessella.plans.binding import Documents
from tessella.plans.compile import truth
from tessella.plans.predicate import parse

MEMBERS, SPANS = 500, 32
EVENTS = "event_type string, sequence bigint, id string, revision string, body string"


def normalize(request: dict[str, Any]) -> dict[str, Any]:
    if not isinstance(request, dict) or not set(request) <= {"selector", "fields", "heartbeat_ms"}:
        raise invalid("a subscription has a selector, fields and heartbeat_ms")
    query.normalize({k: v for k, v in request.items() if k != "heartbeat_ms"})
    return request


def snapshot(docs: Documents, request: dict[str, Any], members: int | None = MEMBERS) -> DataFrame:
    """The members now, by id, as snapshot events; caught_up follows them. Too many are a resource_limit."""
    r = query.normalize({k: v for k, v in normalize(request).items() if k != "heartbeat_ms"})
    df = query.select(docs, r)
    if members is not None and df.limit(members + 1).count() > members:
        raise EngineError("resource_limit", "too many members", limit=members)
    return query.project(docs, df, r).withColumn("event_type", F.lit("snapshot")).orderBy("id")


def transitions(history: Documents, selector: dict[str, Any], sequence: str, deleted: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """The events of a batch of changes: event_type upsert or remove, sequence, id.

    A change of a document that matches is an upsert, whether or not it was a member; of a member that no
    longer matches, or is deleted, a remove; otherwise there is none. members (id): who was one before
    the batch. What a document was before a change is the state after the change before. To find it, the
    batch is cut into SPANS runs of sequences: within a span and id a window looks back one row, and the
    first row there takes the last state of the id's span before, from one row for each id and span. So
    the changes of a document that holds much of the batch are spread over the spans.
    """
    matches = truth(parse(selector), history)
    if deleted:
        matches = matches & ~F.col(deleted)
    rows = history.df.select(history.id_column().alias("id"), F.col(sequence).cast("bigint").alias("sequence"), matches.alias("now"))
    cuts = sorted(set(rows.stat.approxQuantile("sequence", [k / SPANS for k in range(1, SPANS)], 0.01)))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array(F.lit(0.0))
    rows = rows.withColumn("span", F.size(F.filter(bounds, lambda c: c <= F.col("sequence"))))
    ends = rows.groupBy("id", "span").agg(F.max_by("now", "sequence").alias("last"))
    ends = ends.select("id", "span", F.lag("last").over(Window.partitionBy("id").orderBy("span")).alias("earlier"))
    if members is not None:
        ends = ends.join(members.select("id", F.lit(True).alias("_member")), "id", "left").withColumn("earlier", F.coalesce("earlier", "_member")).drop("_member")
    rows = rows.withColumn("before", F.lag("now").over(Window.partitionBy("id", "span").orderBy("sequence"))).join(ends, ["id", "span"])
    was = F.coalesce("before", "earlier", F.lit(False))
    kind = F.when(F.col("now"), "upsert").when(was, "remove")
    return rows.select(kind.alias("event_type"), "sequence", "id").where("event_type is not null")


def events(docs: Documents, history: Documents, request: dict[str, Any], cursor: int | None, sequence: str, floor: int = 0, deleted: str | None = None, members: DataFrame | None = None, most: int | None = MEMBERS) -> DataFrame:
    """What a subscriber at a cursor is sent next: place, event_type, sequence, id, in the order of place, sequence, id.

    Without a cursor, the members now, as snapshot events; from a cursor, the transitions since. Where the history
    below the floor is gone and the cursor with it, first a reset, which voids what the subscriber holds, and then a
    new snapshot. In every case caught_up comes last, with the last sequence of the history. docs: the documents as
    they are; history: changes (`transitions`), of which those after the cursor are read; members: who was one then.
    """
    last = history.df.agg(F.coalesce(F.max(sequence), F.lit(0)).cast("bigint").alias("last"))
    spark = docs.df.sparkSession
    none = F.lit(None).cast("string")
    done = last.select(F.lit(2).alias("place"), F.lit("caught_up").alias("event_type"), F.col("last").alias("sequence"), none.alias("id"))
    if cursor is not None and cursor >= floor:
        later = Documents(history.df.where(F.col(sequence) > cursor), history.id, history.body, history.revision, history.json, history.null)
        out = transitions(later, request.get("selector", {}), sequence, deleted, members).select(F.lit(1).alias("place"), "event_type", "sequence", "id")
        return out.unionByName(done).orderBy("place", "sequence", "id")
    out = snapshot(docs, request, most).select(F.lit(1).alias("place"), "event_type", F.lit(None).cast("bigint").alias("sequence"), "id").unionByName(done)
    if cursor is not None:
        reset = spark.range(1).select(F.lit(0).alias("place"), F.lit("reset").alias("event_type"), F.lit(floor).cast("bigint").alias("sequence"), none.alias("id"))
        out = reset.unionByName(out)
    return out.orderBy("place", "sequence", "id")


def error_event(error: EngineError) -> dict[str, Any]:
    """What a subscriber is sent before its stream ends with an error."""
    return {"event_type": "error", "code": error.code, "message": error.message, "retryable": error.retryable}


def members_after(history: Documents, selector: dict[str, Any], sequence: str, deleted: str | None = None) -> DataFrame:
    """Who is a member after the last change of each document."""
    matches = truth(parse(selector), history)
    if deleted:
        matches = matches & ~F.col(deleted)
    rows = history.df.select(history.id_column().alias("id"), F.col(sequence).alias("_s"), matches.alias("_m"))
    return rows.groupBy("id").agg(F.max_by("_m", "_s").alias("_m")).where("_m").select("id")


def stateful(stream: DataFrame, selector: dict[str, Any]) -> DataFrame:
    """The same on a stream of (sequence, id, revision, deleted, body as JSON text), with one boolean of
    state for each document; events as EVENTS."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    docs = Documents(stream.withColumn("_v", F.try_parse_json("body")), "id", body="_v")
    judged = docs.df.withColumn("now", truth(parse(selector), docs) & ~F.coalesce("deleted", F.lit(False))).select("sequence", "id", "revision", "body", "now")

    class Membership(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.member = handle.getValueState("member", T.StructType([T.StructField("is", T.BooleanType())]))

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            was = self.member.get()[0] if self.member.exists() else False
            out = []
            for r in pd.concat(rows).sort_values("sequence").itertuples():
                if r.now:
                    out.append(("upsert", r.sequence, key[0], r.revision, r.body))
                elif was:
                    out.append(("remove", r.sequence, key[0], r.revision, None))
                was = bool(r.now)
            self.member.update((was,))
            yield pd.DataFrame(out, columns=["event_type", "sequence", "id", "revision", "body"])

        def close(self) -> None:
            pass

    return judged.groupBy("id").transformWithStateInPandas(Membership(), EVENTS, "append", "none")


def follow(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A change table as a stream; at most `files` new files a batch, so a slow reader is not flooded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def publish(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes events as JSON lines and stops when it has caught up; started again, it goes on from there."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
