"""Materialized views kept up to date from changes: contributions, and documents generated from them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.errors import EngineError, invalid
from tessella.functions.canonical import digest
from tessella.operators import views
from tessella.plans.binding import Documents
from tessella.sources.versions import Versions


def group_id(keys: list[Any]) -> str:
    """The id of a group's document."""
    return "g-" + digest(keys)


def map_id(source: str, document: str) -> str:
    """The id of the document that a source's document gives in a map-only view."""
    return "m-" + digest([source, document])


def _component(k: Any) -> Any:
    return [None, False, True, k["num"], k["str"]][k["tag"]]


class MaterializedView:
    """A view's contributions, in versions of a Parquet table, and the documents they give.

    A batch of changes replaces the contributions of its documents: it writes these alone, as a layer over
    those there are (`Versions`), and only groups that lost or gained a contribution are reduced again, so
    minima need no inverse. Each batch is a new version, with the sequence it went up to: a batch that was
    applied already changes nothing, and readers never see half of one. Views with a reducer name a
    group_level, others do not.
    """

    def __init__(self, spark: SparkSession, path: str, definition: dict[str, Any], group_level: int | None = None, source: str = "source"):
        self.spark, self.source = spark, source
        self.versions = Versions(spark, path, "contributions")
        self.view = views.define(definition)
        if (self.view.reducer is None) != (group_level is None):
            raise invalid("group_level goes with a reducer, and only with one")
        if group_level is not None and not 0 <= group_level <= len(self.view.key):
            raise invalid("group_level is between 0 and the key's length")
        self.level, self.enabled = group_level, True

    def state(self) -> dict[str, Any]:
        """version, sequence, epoch of what readers see."""
        return {"sequence": 0, "epoch": None} | self.versions.state()

    def contributions(self) -> DataFrame | None:
        return self.versions.read()

    def _keys(self) -> list[str]:
        return [f"key{n}" for n in range(len(self.view.key))]

    def apply(self, changes: Documents, through: int, deleted: str | None = None, sequence: str | None = None, expected: int | None = None, epoch: str | None = None) -> DataFrame | None:
        """Takes a batch of changed documents (several changes of one: the last counts) up to `through`.
        Returns the group keys touched, or None if the batch was applied before. expected: the sequence that
        the batch starts from; another one is a conflict. A changed epoch asks for a rebuild."""
        if not self.enabled:
            raise EngineError("view_not_caught_up", "the view is disabled")
        held = self.state()
        if held["epoch"] not in (None, epoch):
            raise EngineError("source_history_reset", "the source has begun anew")
        if through <= held["sequence"]:
            return None
        if expected is not None and expected != held["sequence"]:
            raise EngineError("checkpoint_conflict", "the batch does not follow on", at=held["sequence"])
        df = changes.df
        if sequence:
            whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
            df = df.groupBy(changes.id_column().alias("_id")).agg(F.max_by(whole, F.col(sequence)).alias("c")).select("c.*")
        live = df.where(~F.col(deleted)) if deleted else df
        new = views.rows(Documents(live, changes.id, changes.body, changes.revision, changes.json, changes.null), self.view)
        touched = Documents(df, changes.id).df.select(changes.id_column().alias("id")).distinct()
        state = self.versions.append(new, touched, sequence=through, epoch=epoch)
        keys = self._keys()[: self.level or 0]
        own, before = state["layer"], self.versions.read(state["before"])
        written, touched = self.versions.rows(own), self.versions.ids(own)
        groups = written.select(*keys, F.lit(1).alias("_one"))
        if before is not None:
            groups = groups.union(before.join(touched, "id", "left_semi").select(*keys, F.lit(1).alias("_one")))
        return groups.distinct().drop("_one") if keys else groups.limit(1).drop("_one")

    def documents(self, groups: DataFrame | None = None, exact: bool = True) -> DataFrame:
        """The generated documents, id and body (JSON text): a group's key and value, or a document's key,
        value and source. groups: only these; groups without contributions are not there."""
        rows = self.contributions()
        if rows is None:
            return self.spark.createDataFrame([], "id string, body string")
        if self.view.reducer is None:
            source, keys = self.source, self._keys()

            def made(pdf: pd.DataFrame) -> pd.Series:
                return pd.Series([map_id(source, i) for i in pdf["id"]])

            def body(pdf: pd.DataFrame) -> pd.Series:
                from tessella.functions.canonical import canonical, decode

                out = []
                for r in pdf.to_dict("records"):
                    b = {"key": [_component(r[k]) for k in keys], "source_database_uuid": source, "source_document_id": r["id"]}
                    out.append(canonical(b | ({} if r["value"] is None else {"value": decode(r["value"])})))
                return pd.Series(out)

            columns = F.struct("id", *keys, "value")
            return rows.select(F.pandas_udf(made, "string")(columns).alias("id"), F.pandas_udf(body, "string")(columns).alias("body"))
        keys = self._keys()[: self.level]
        if groups is not None and keys:
            rows = rows.join(groups, keys, "left_semi")
        reduced = views.finite(views.reduced(rows, self.view, self.level, exact))
        reducer, held = self.view.reducer, keys

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            from tessella.functions.canonical import canonical

            out = []
            for r in pdf.to_dict("records"):
                key = [_component(r[k]) for k in held]
                if reducer == "_stats":
                    value = {k: r[k] if r[k] is None or r[k] == r[k] else None for k in ("count", "sum", "min", "max", "sumsqr")}
                else:
                    value = r[reducer[1:]]
                    value = None if value is None or value != value else value
                out.append((group_id(key), canonical({"key": key, "value": value})))
            return pd.DataFrame(out, columns=["id", "body"])

        columns = F.struct(*reduced.columns)
        return reduced.select(F.pandas_udf(group, "id string, body string")(columns).alias("d")).select("d.*")

    def query(self, consistency: str = "stale_ok", current: int | None = None, update: Callable[[], object] | None = None) -> DataFrame:
        """The generated documents, as fresh as asked for: stale_ok, those there are; update_after, the same, and
        `update`, which applies what is new, runs for later readers; consistent, those up to the sequence `current`,
        after an update if they lag, or view_not_caught_up if they still do then."""
        if consistency not in views.CONSISTENCY:
            raise invalid("consistency is one of " + ", ".join(views.CONSISTENCY))
        if consistency == "consistent":
            if current is None:
                raise invalid("consistent needs the current sequence")
            if self.state()["sequence"] < current and update:
                update()
            if self.state()["sequence"] < current:
                raise EngineError("view_not_caught_up", "the view has not caught up", at=self.state()["sequence"])
        out = self.documents()  # of the version that there is now
        if consistency == "update_after" and update:
            update()
        return out

    def rebuild(self, docs: Documents, through: int, epoch: str | None = None) -> None:
        """From all documents, as one version; then replay what came after."""
        self.versions.write(views.rows(docs, self.view), sequence=through, epoch=epoch)

    def changed(self, before: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """What a batch changes in generated documents `before` (id, body): id, body, action put or delete;
        documents whose body is as before are not there."""
        after = self.documents(groups)
        joined = before.select("id", F.col("body").alias("old")).join(after, "id", "full_outer")
        return joined.where(~F.col("old").eqNullSafe(F.col("body"))).select("id", "body", F.when(F.col("body").isNull(), "delete").otherwise("put").alias("action"))

    def follow(self, stream: DataFrame, checkpoint: str, id: str, body: str | None, sequence: str, deleted: str | None = None) -> StreamingQuery:
        """Applies a stream of changes batch by batch until it has caught up; run again, it goes on."""

        def batch(df: DataFrame, number: int) -> None:
            if df.isEmpty():
                return
            through = df.agg(F.max(sequence)).first()[0]
            frame = df.withColumn("_v", F.try_parse_json(body)) if body else df
            self.apply(Documents(frame, id, "_v" if body else None), int(through), deleted, sequence)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
