"""Shadows: stored copies that eventual reads are served from, if they are of the right generation."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from tessella.errors import EngineError, invalid
from tessella.operators import query
from tessella.plans.binding import Documents
from tessella.sources.versions import Versions


class Shadow:
    """A copy of a document set in versions, each with the generation it belongs to and the source's sequence
    (watermark) that it goes up to. Reads name the generation that is wanted; a copy of another one, or one that
    cannot be read, serves nothing, and what a copy lacks is read from the source."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions, self.retired = spark, Versions(spark, path, "shadow"), False

    def build(self, docs: Documents, generation: str, watermark: int) -> None:
        """All documents anew, as a generation of their own."""
        self.versions.write(docs.df.withColumn("id", docs.id_column()), generation=generation, watermark=watermark)
        self.retired = False

    def refresh(self, changed: Documents, generation: str, watermark: int, deleted: str | None = None) -> None:
        """What changed since, as a layer; only to the generation that it was made for."""
        state = self.versions.state()
        if state.get("generation") != generation:
            raise EngineError("source_history_reset", "the shadow is of another generation", generation=state.get("generation"))
        if watermark <= state["watermark"]:
            return
        rows = changed.df.withColumn("id", changed.id_column())
        live = rows.where(~F.col(deleted)).drop(deleted) if deleted else rows
        self.versions.append(live, rows.select("id").distinct(), generation=generation, watermark=watermark)

    def get(self, source: Documents, ids: list[str], generation: str, consistency: str = "eventual") -> tuple[list[Row | None], dict[str, Any]]:
        """A row, or None, for each id in order, and who served them: `shadow` with its watermark, or `source`.
        consistency: eventual, or primary, which passes the shadow by."""
        if consistency not in ("eventual", "primary"):
            raise invalid("consistency is eventual or primary")
        if not 0 < len(ids) <= query.MOST:
            raise invalid(f"1 to {query.MOST} ids")
        held: dict[str, Row] = {}
        meta: dict[str, Any] = {"served_by": "source"}
        state = self.versions.state() if consistency == "eventual" and not self.retired else {}
        if state.get("generation") == generation:
            try:
                held = {r["id"]: r for r in self.versions.read(state).where(F.col("id").isin(*ids)).collect()}
                meta = {"served_by": "shadow", "watermark": state["watermark"]}
            except AnalysisException:  # its files are gone; this copy is not asked again
                self.retired = True
        lacking = [i for i in dict.fromkeys(ids) if i not in held]
        if lacking:
            found = query.get(source, lacking).where("found").collect()
            held |= {r["asked"]: r for r in found}
        return [held.get(i) for i in ids], meta
