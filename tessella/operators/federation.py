"""One query over several document sets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import EngineError, invalid
from tessella.functions.canonical import decode, digest
from tessella.operators import bookmarks, query
from tessella.plans.binding import Documents
from tessella.plans.compile import condition

SOURCES = 16
SOURCE = "source_database_uuid"
_KEYS = {"selector", "sort", "fields", "limit", "bookmark"}


def normalize(sources: Mapping[str, Documents], request: dict[str, Any]) -> query.Request:
    if not 0 < len(sources) <= SOURCES:
        raise invalid(f"1 to {SOURCES} sources")
    if "search" in request or "index" in request:
        raise invalid("a federated query has neither search nor index")
    return query.normalize(request, _KEYS)


def _version(sources: Mapping[str, Documents]) -> str:
    return digest([[name, d.snapshot()] for name, d in sources.items()])


def union(sources: Mapping[str, Documents], r: query.Request) -> DataFrame:
    """Matching documents of all sources: source, id, sort keys k0.., and body or fields.

    Each source is filtered and projected by itself, so its filters reach its scan; then they are one
    union, and Spark's order and limit do what a merge of sorted sources would.
    """
    parts = []
    for name, docs in sources.items():
        df = docs.df.where(condition(r.predicate, docs)).withColumn(SOURCE, F.lit(name))
        keys = [v.sort_key().alias(f"k{n}") for n, (v, _) in enumerate(query.order_keys(docs, r.sort))]
        df = df.select(*[c for c in df.columns], *keys)
        shown = query.project(docs, df, r, keep=(SOURCE, *(f"k{n}" for n in range(len(keys)))))
        if r.fields is None:
            shown = shown.withColumn("body", F.to_json("body"))
        parts.append(shown.select(SOURCE, "id", *(f"k{n}" for n in range(len(keys))), "body" if r.fields is None else "fields"))
    return reduce(DataFrame.unionByName, parts)


def page(sources: Mapping[str, Documents], request: dict[str, Any] | query.Request, extra: int = 0) -> DataFrame:
    """In the order of the sort, then source, then id."""
    r = request if isinstance(request, query.Request) else normalize(sources, request)
    df = union(sources, r)
    order = [c for n, (_, descending) in enumerate(r.sort) for c in [F.col(f"k{n}").desc_nulls_first() if descending else F.col(f"k{n}").asc_nulls_last()]]
    if r.bookmark:
        payload = bookmarks.read(r.bookmark)
        bookmarks.check(payload, r.fingerprint, _version(sources))
        plain = Documents(df, "id")
        as_sort = replace(r, sort=[((f"k{n}",), d) for n, (_, d) in enumerate(r.sort)])
        df = df.where(query.after(plain, as_sort, payload["k"], extra=(SOURCE,)))
    return df.orderBy(*order, SOURCE, "id").limit(r.limit + extra)


def execute(sources: Mapping[str, Documents], request: dict[str, Any], budget: int | None = None) -> dict[str, Any]:
    """A page, has_more and a bookmark that any change of a source's version makes stale. Sort keys must be
    scalars of one type over all sources if tables are typed. budget: documents at most that may match in all
    sources together; more are a resource_limit, and nothing is left out. Without one, any number may."""
    r = normalize(sources, request)
    if budget is not None and union(sources, r).limit(budget + 1).count() > budget:
        raise EngineError("resource_limit", "too many candidates", limit=budget)
    names = [f"k{n}" for n in range(len(r.sort))]
    df = page(sources, r, 1)
    held = df.withColumn("_cursor", F.to_json(F.struct(*names, SOURCE, "id"), {"ignoreNullFields": "false"})).collect()
    more, held = len(held) > r.limit, held[: r.limit]
    mark = bookmarks.encode({"f": r.fingerprint, "v": _version(sources), "k": decode(held[-1]["_cursor"])}) if more else None
    return {"results": [{k: v for k, v in x.asDict().items() if k not in names and k != "_cursor"} for x in held], "has_more": more, "bookmark": mark}


class SavedQueries:
    """Named federated queries; callers choose only limit and bookmark."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[Mapping[str, Documents], dict[str, Any]]] = {}

    def save(self, name: str, sources: Mapping[str, Documents], request: dict[str, Any]) -> None:
        normalize(sources, request)
        self.held[name] = (sources, {k: v for k, v in request.items() if k not in ("limit", "bookmark")})

    def execute(self, name: str, limit: int | None = None, bookmark: str | None = None) -> dict[str, Any]:
        if name not in self.held:
            raise EngineError("document_not_found", "no such saved query", name=name)
        sources, request = self.held[name]
        return execute(sources, request | ({"limit": limit} if limit is not None else {}) | ({"bookmark": bookmark} if bookmark else {}))
