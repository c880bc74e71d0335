"""Queries over documents: selection, order, pages, projection, explanation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import EngineError, invalid
from tessella.functions import pointer
from tessella.functions.canonical import digest
from tessella.operators import bookmarks, search
from tessella.plans.binding import Documents, TypedValue, Value, VariantValue
from tessella.plans.compile import condition
from tessella.plans.predicate import Both, Field, Predicate, parse, type_of

LIMIT, MOST = 50, 500
_KEYS = {"selector", "sort", "fields", "limit", "bookmark", "index", "search", "scan_threshold"}


@dataclass
class Request:
    """A checked query request."""

    selector: dict[str, Any]
    predicate: Predicate
    sort: list[tuple[tuple[str, ...], bool]]  # tokens, descending
    fields: list[str] | None
    limit: int
    bookmark: str | None
    index: str | None
    search: search.Search | None
    scan_threshold: int | None
    fingerprint: str


def normalize(request: dict[str, Any], allowed: set[str] = _KEYS, most: int = MOST) -> Request:
    if not isinstance(request, dict) or not set(request) <= allowed:
        raise invalid("unknown fields in the request", fields=sorted(set(request) - allowed) if isinstance(request, dict) else None)
    selector = request.get("selector", {})
    predicate = parse(selector)
    sort = []
    for item in request.get("sort") or []:
        item = {"path": item} if isinstance(item, str) else item
        if not isinstance(item, dict) or not set(item) <= {"path", "direction"} or item.get("direction", "asc") not in ("asc", "desc"):
            raise invalid("a sort key has a path and a direction, asc or desc")
        sort.append((pointer.parse(item.get("path")), item.get("direction", "asc") == "desc"))
    fields = request.get("fields")
    if fields is not None:
        if not isinstance(fields, (list, tuple)) or not 0 < len(fields) <= most:
            raise invalid("fields must be pointers")
        for f in fields:
            pointer.parse(f)
    limit = request.get("limit", LIMIT)
    if isinstance(limit, bool) or not isinstance(limit, int) or not 0 < limit <= most:
        raise invalid(f"limit must be 1 to {most}")
    text = search.normalize(request["search"]) if request.get("search") is not None else None
    if text and sort:
        raise invalid("a full-text query is ordered by rank")
    shape = {"selector": selector, "sort": [["/".join(t), d] for t, d in sort], "fields": list(fields) if fields is not None else None, "search": request.get("search"), "index": request.get("index")}
    return Request(selector, predicate, sort, list(fields) if fields is not None else None, limit, request.get("bookmark"), request.get("index"), text, request.get("scan_threshold"), digest(shape))


def select(docs: Documents, request: Request) -> DataFrame:
    """All matching documents, unordered, with all columns (full-text: and `rank`). A full-text search is served by
    the stored index in docs.extra["search_index"], if that has the fields asked for, and by a scan if not."""
    df = docs.df
    if request.scan_threshold is not None and df.limit(request.scan_threshold).count() >= request.scan_threshold:
        raise EngineError("index_required", "the scan would read too many documents", threshold=request.scan_threshold)
    if request.search:
        index = docs.extra.get("search_index")
        if index is None or index.fields != request.search.fields:
            df = search.ranked(docs, request.search)
        else:
            hits = index.ranked(request.search).withColumnRenamed("id", "_hit")
            df = df.join(hits, docs.id_column() == hits["_hit"]).drop("_hit")
    return df.where(condition(request.predicate, docs))


def order_keys(docs: Documents, sort: list[tuple[tuple[str, ...], bool]]) -> list[tuple[Value, bool]]:
    return [(docs.at(tokens), descending) for tokens, descending in sort]


def ordering(docs: Documents, request: Request, extra: tuple[str, ...] = ()) -> list[Column]:
    """Sort columns: missing last ascending and first descending, then `extra` columns, then the id."""
    if request.search:
        keys = [F.col("rank").asc()]
    else:
        keys = []
        for v, descending in order_keys(docs, request.sort):
            c = v.sort_key()
            keys.append(c.desc_nulls_first() if descending else c.asc_nulls_last())
    return [*keys, *(F.col(c).asc() for c in extra), docs.id_column().asc()]


def _cursor_of(docs: Documents, request: Request) -> Column:
    """What a bookmark keeps of a document's place, as JSON values."""
    parts = [F.col("rank")] if request.search else []
    for v, _ in order_keys(docs, request.sort) if not request.search else ():
        parts.append(v.sort_key())
    return F.struct(*(p.alias(f"k{n}") for n, p in enumerate(parts)), docs.id_column().alias("id"))


def after(docs: Documents, request: Request, cursor: dict[str, Any], extra: tuple[str, ...] = ()) -> Column:
    """Documents strictly after a cursor in the order: lexicographic over keys, extras and the id."""
    steps: list[tuple[Column, Column]] = []  # (equal, beyond)
    if request.search:
        rank = F.lit(float(cursor["k0"]))
        steps.append((F.col("rank") == rank, F.col("rank") > rank))
    else:
        for n, (v, descending) in enumerate(order_keys(docs, request.sort)):
            at, c = cursor[f"k{n}"], v.sort_key()
            if isinstance(at, dict):
                here = F.struct(F.lit(at["missing"]).alias("missing"), F.lit(at["rank"]).alias("rank"), F.lit(at["num"]).cast("double").alias("num"), F.lit(at["str"]).cast("string").alias("str"))
                steps.append((c == here, c < here if descending else c > here))
            elif at is None:
                steps.append((c.isNull(), c.isNotNull() if descending else F.lit(False)))
            else:
                steps.append((c == F.lit(at), c < F.lit(at) if descending else c.isNull() | (c > F.lit(at))))
    steps += [(F.col(c) == F.lit(cursor[c]), F.col(c) > F.lit(cursor[c])) for c in extra]
    steps.append((docs.id_column() == F.lit(cursor["id"]), docs.id_column() > F.lit(cursor["id"])))
    out, same = F.lit(False), F.lit(True)
    for equal, beyond in steps:
        out = out | (same & beyond)
        same = same & equal
    return out


def project(docs: Documents, df: DataFrame, request: Request, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without fields: id, revision and body. With fields: id, revision and a map of pointer to JSON text,
    in which missing ones are left out; see `columns` for typed columns."""
    lead = [*(F.col(c) for c in keep), docs.id_column().alias("id"), *([F.col(docs.revision).alias("revision")] if docs.revision else [])]
    rank = [F.col("rank")] if request.search else []
    if request.fields is None:
        body = F.col(docs.body) if docs.body else F.struct(*(F.col(f"`{c}`") for c in docs.df.columns))
        return df.select(*lead, body.alias("body"), *rank)
    pairs = []
    for f in request.fields:
        v = docs.at(pointer.parse(f))
        text = F.when(v.exists(), v.json() if isinstance(v, VariantValue) else _plain_json(v))
        pairs += [F.lit(f), text]
    return df.select(*lead, F.map_filter(F.create_map(*pairs), lambda k, x: x.isNotNull()).alias("fields"), *rank)


def _plain_json(v: TypedValue) -> Column:
    if v.c is None:
        return F.lit(None).cast("string")
    text = F.regexp_extract(F.to_json(F.array(v.c), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)
    return text


def columns(docs: Documents, df: DataFrame, fields: list[str]) -> list[Column]:
    """The fields of a typed table as columns named by the last token."""
    out = []
    for f in fields:
        tokens = pointer.parse(f)
        v = docs.at(tokens)
        out.append((v.c if isinstance(v, TypedValue) else v.json()).alias(tokens[-1]))
    return out


def page(docs: Documents, request: dict[str, Any] | Request, extra: int = 0) -> DataFrame:
    """The page of documents that a request asks for, all columns, in order; `extra` more rows."""
    r = request if isinstance(request, Request) else normalize(request)
    df = select(docs, r)
    if r.bookmark:
        payload = bookmarks.read(r.bookmark)
        bookmarks.check(payload, r.fingerprint, docs.snapshot())
        df = df.where(after(docs, r, payload["k"]))
    return df.orderBy(*ordering(docs, r)).limit(r.limit + extra)


def execute(docs: Documents, request: dict[str, Any]) -> dict[str, Any]:
    """The whole answer: results (Rows, at most limit), has_more, bookmark, how many rows were examined for it (those
    fetched), and how it was planned. A search of more than CANDIDATES documents is refused, unless the request
    sets max_candidates itself."""
    r = normalize(request)
    if r.search and r.search.candidates is None:
        r.search.candidates = search.CANDIDATES
    found = page(docs, r, 1).withColumn("_cursor", F.to_json(_cursor_of(docs, r), {"ignoreNullFields": "false"}))
    held = project(docs, found, r, keep=("_cursor",)).collect()
    examined = len(held)
    more, held = len(held) > r.limit, held[: r.limit]
    mark = None
    if more:
        from tessella.functions.canonical import decode

        mark = bookmarks.encode({"f": r.fingerprint, "v": docs.snapshot(), "k": decode(held[-1]["_cursor"])})
    results = [{k: x for k, x in row.asDict().items() if k != "_cursor"} for row in held]
    return {"results": results, "documents": results, "bookmark": mark, "has_more": more, "examined": examined, "sequence": docs.snapshot()} | plan(docs, r)


def plan(docs: Documents, request: dict[str, Any] | Request, indexes: list[dict[str, Any]] | None = None) -> dict[str, Any]:
    """What would serve the query: plan_kind, selected indexes and what of the selector they take.

    Indexes are metadata here (Parquet statistics and partitions do their work); the choice follows hint,
    longest run of equality fields, then range, then order, then name.
    """
    r = request if isinstance(request, Request) else normalize(request)
    named = {i["name"]: i for i in indexes or docs.extra.get("indexes", [])}
    if r.index is not None and r.index not in named:
        raise EngineError("invalid_index_hint", "no such index", index=r.index)
    if r.search:
        chosen = [n for n, i in named.items() if i["type"] == "full_text"][:1]
        kind = "full_text"
    else:
        branches = r.predicate.parts if type(r.predicate).__name__ == "Either" else (r.predicate,)
        picks = [_pick(b, r, named) for b in branches]
        chosen = list(dict.fromkeys(p for p in picks if p)) if all(picks) else []
        kind = "bounded_scan" if not chosen else "single" if len(branches) == 1 else "union"
    described = {"plan_kind": kind, "selected_indexes": chosen}
    return described | {"plan_digest": digest({"plan": described, "query": r.fingerprint})}


def _pick(p: Predicate, r: Request, named: dict[str, dict[str, Any]]) -> str | None:
    tests = [x for x in (p.parts if isinstance(p, Both) else (p,)) if isinstance(x, Field)]
    equal = {x.tokens for x in tests if x.op in ("eq", "in") and type_of(x.operand if x.op == "eq" else x.operand[0]) not in ("array", "object")}
    ranged = {x.tokens for x in tests if x.op in ("gt", "gte", "lt", "lte", "beginsWith")}
    best = None
    for name, i in sorted(named.items()):
        if i["type"] != "structured":
            continue
        paths = [pointer.parse(f["path"] if isinstance(f, dict) else f) for f in i["fields"]]
        n = 0
        while n < len(paths) and paths[n] in equal:
            n += 1
        span = n < len(paths) and paths[n] in ranged
        if n or span:
            score = (r.index == name, n, span, [t for t, _ in r.sort] == paths[n : n + len(r.sort)] and bool(r.sort))
            if best is None or score > best[0]:
                best = (score, name)
    return best and best[1]


def explain(docs: Documents, request: dict[str, Any]) -> dict[str, Any]:
    """The plan and Spark's physical plan, without running the query."""
    r = normalize(request)
    df = page(docs, r, 1)
    return plan(docs, r) | {"fingerprint": r.fingerprint, "limit": r.limit, "physical": df._jdf.queryExecution().executedPlan().toString()}


def get(docs: Documents, ids: list[str]) -> DataFrame:
    """Bulk read: a row for each id asked for, in order, with `found`."""
    if not 0 < len(ids) <= MOST:
        raise invalid(f"1 to {MOST} ids")
    asked = docs.df.sparkSession.createDataFrame([(n, i) for n, i in enumerate(ids)], "position int, asked string")
    rows = docs.df.where(docs.among(ids)).withColumn("_id", docs.id_column())
    joined = asked.join(rows, asked["asked"] == rows["_id"], "left")
    return joined.withColumn("found", F.col("_id").isNotNull()).drop("_id").orderBy("position")


def get_one(docs: Documents, id: str) -> Any:
    """Point read: the row, or document_not_found."""
    row = docs.df.where(docs.among([id])).first()
    if row is None:
        raise EngineError("document_not_found", "no such document", id=id)
    return row


def scan_page(docs: Documents, after_id: str | None, limit: int) -> DataFrame:
    """Documents by id after a cursor, as rebuilds read them."""
    df = docs.df if after_id is None else docs.df.where(docs.id_column() > after_id)
    return df.orderBy(docs.id_column()).limit(limit)


__all__ = ["T", "Request", "columns", "execute", "explain", "get", "get_one", "normalize", "page", "plan", "project", "scan_page", "select"]
