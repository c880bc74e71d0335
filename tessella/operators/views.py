"""Declarative map/reduce views."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import EngineError, invalid
from tessella.functions import pointer
from tessella.functions.canonical import digest
from tessella.operators import bookmarks
from tessella.plans.binding import Documents, TypedValue, Value
from tessella.plans.compile import condition
from tessella.plans.predicate import Predicate, parse, type_of

REDUCERS = ("_count", "_sum", "_min", "_max", "_stats")
CONSISTENCY = ("stale_ok", "update_after", "consistent")
KEYS, LIMIT, MOST = 8, 50, 500
_TAG = {"null": 0, "number": 3, "string": 4}


@dataclass
class View:
    """A checked definition: name, selector, key expressions, a value expression, a reducer."""

    name: str
    predicate: Predicate
    key: list[tuple[str, Any]]  # ("path", tokens) or ("literal", scalar)
    value: tuple[str, Any] | None
    reducer: str | None
    digest: str


def define(definition: dict[str, Any]) -> View:
    if not isinstance(definition, dict) or not set(definition) <= {"name", "selector", "key", "value", "reducer"}:
        raise invalid("unknown fields in the view")
    name, key, reducer = definition.get("name"), definition.get("key"), definition.get("reducer")
    if not isinstance(name, str) or not name:
        raise invalid("a view has a name")
    if not isinstance(key, (list, tuple)) or len(key) > KEYS:
        raise invalid(f"a key is a list of up to {KEYS} expressions")
    if reducer is not None and reducer not in REDUCERS:
        raise invalid("unknown reducer", reducer=reducer)
    value = definition.get("value")
    return View(name, parse(definition.get("selector", {})), [_expression(k) for k in key], _expression(value) if value is not None else None, reducer, digest(definition))


def _expression(e: Any) -> tuple[str, Any]:
    if isinstance(e, dict) and set(e) == {"path"}:
        return "path", pointer.parse(e["path"], empty=True)
    if isinstance(e, dict) and set(e) == {"literal"} and type_of(e["literal"]) not in ("array", "object"):
        return "literal", e["literal"]
    raise invalid("an expression is a path or a scalar literal")


def key_literal(x: Any) -> Column:
    """A key component: null < false < true < numbers < strings."""
    kind = type_of(x)
    if kind in ("array", "object"):
        raise invalid("key components are scalars")
    tag = 1 + int(x) if kind == "boolean" else _TAG[kind]
    return F.struct(
        F.lit(tag).alias("tag"), F.lit(float(x) if kind == "number" else None).cast("double").alias("num"), F.lit(x if kind == "string" else None).cast("string").alias("str")
    )


def _key(docs: Documents, e: tuple[str, Any]) -> Column:
    return key_literal(e[1]) if e[0] == "literal" else docs.at(e[1]).key()


def _number(docs: Documents, e: tuple[str, Any] | None) -> Column:
    if e is None:
        return F.lit(None).cast("double")
    if e[0] == "literal":
        return F.lit(float(e[1]) if type_of(e[1]) == "number" else None).cast("double")
    return docs.at(e[1]).number()


def _json(docs: Documents, e: tuple[str, Any] | None) -> Column:
    if e is None:
        return F.lit(None).cast("string")
    if e[0] == "literal":
        from tessella.functions.canonical import canonical

        return F.lit(canonical(e[1]))
    v: Value = docs.at(e[1])
    if isinstance(v, TypedValue):
        from tessella.operators.query import _plain_json

        return F.when(v.exists(), _plain_json(v))
    return F.when(v.exists(), v.json())


def rows(docs: Documents, view: View) -> DataFrame:
    """The map's rows: id, key0..keyN (ordered structs), num (numeric value), value (JSON text; NULL: omitted).

    A document without some key component, or with one that is no scalar, has no row; null is a key.
    """
    keys = [_key(docs, e).alias(f"key{n}") for n, e in enumerate(view.key)]
    df = docs.df.where(condition(view.predicate, docs))
    out = df.select(docs.id_column().alias("id"), *keys, _number(docs, view.value).alias("num"), _json(docs, view.value).alias("value"))
    for n in range(len(view.key)):
        out = out.where(F.col(f"key{n}").isNotNull())
    return out


def _beyond(key: list[str], bound: list[Any], strict: bool, above: bool) -> Column:
    """Keys above (or below) a bound that may be shorter; a shorter key comes before those it begins."""
    out, same = F.lit(False), F.lit(True)
    for name, x in zip(key, bound, strict=False):
        c, b = F.col(name), key_literal(x)
        out = out | (same & (c > b if above else c < b))
        same = same & (c == b)
    if len(bound) < len(key):
        return out | same if above else out
    if len(bound) > len(key):
        return out if above else out | same
    return out if strict else out | same


def ranged(df: DataFrame, view: View, options: dict[str, Any]) -> DataFrame:
    """Rows within key, start_key and end_key."""
    names = [f"key{n}" for n in range(len(view.key))]
    if "key" in options:
        if "start_key" in options or "end_key" in options:
            raise invalid("key excludes a range")
        if len(options["key"]) != len(names):
            return df.where(F.lit(False))
        for name, x in zip(names, options["key"], strict=True):
            df = df.where(F.col(name) == key_literal(x))
        return df
    if "start_key" in options:
        df = df.where(_beyond(names, options["start_key"], False, True))
    if "end_key" in options:
        df = df.where(_beyond(names, options["end_key"], not options.get("inclusive_end", True), False))
    return df


def reduced(df: DataFrame, view: View, level: int | None = None, exact: bool = True) -> DataFrame:
    """A row for each key prefix of `level` components (all by default): keys and `count, sum, min, max,
    sumsqr` as far as the reducer needs them. Level 0 is one group, if there are rows.

    _count counts rows, the others only numbers. Sums are those of unbounded precision, rounded once, whatever the
    order of the rows; without `exact`, binary64 sums in the order that rows come in.
    """
    level = len(view.key) if level is None else level
    if isinstance(level, bool) or not 0 <= level <= len(view.key):
        raise invalid("group_level is between 0 and the key's length")
    names = [f"key{n}" for n in range(level)] or [F.lit(0).alias("all")]
    if exact and view.reducer in ("_sum", "_stats"):
        return _exact(df, view, level)
    x = F.col("num")
    total = F.coalesce(F.sum(x), F.lit(0.0)).alias("sum")
    aggregates = {
        "_count": [F.count("*").alias("count")],
        "_sum": [total],
        "_min": [F.min(x).alias("min")],
        "_max": [F.max(x).alias("max")],
        "_stats": [F.count(x).alias("count"), total, F.min(x).alias("min"), F.max(x).alias("max"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("sumsqr")],
    }[view.reducer]
    out = df.groupBy(*names).agg(*aggregates)
    return out.drop("all") if level == 0 else out


def _exact(df: DataFrame, view: View, level: int) -> DataFrame:
    """Sums of binary64 numbers as if in unbounded precision, rounded once.

    A number is a whole one times a power of two. Whole parts of one power are summed as decimals, which is
    exact, combined before the shuffle and does not care for order; a group then has a few thousand
    numbers at most, which are added as rationals.
    """
    names = [f"key{n}" for n in range(level)] or ["all"]
    x = F.col("num")
    power = F.when(x == 0, 0).otherwise(F.greatest(F.lit(-1074), F.floor(F.log2(F.abs(x))).cast("int") - 54))
    # In two steps, as 2^-power itself may be out of range.
    half = (power / 2).cast("int")
    whole = (x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power)).cast("decimal(20,0)")
    # Rows without a number have no power, so a group is there even if none has one.
    parts = df.withColumn("all", F.lit(0)).select(*names, F.when(x.isNotNull(), power).alias("power"), whole.alias("whole"), x.alias("x"))
    sums = {"s": F.sum("whole")}
    if view.reducer == "_stats":
        high = F.floor(F.col("whole") / 10**9).cast("decimal(20,0)")
        parts = parts.withColumn("h", high).withColumn("l", (F.col("whole") - high * 10**9).cast("decimal(20,0)"))
        sums |= {a + b: F.sum((F.col(a) * F.col(b)).cast("decimal(38,0)")) for a, b in ("hh", "hl", "ll")}
    by = parts.groupBy(*names, "power").agg(*(c.alias(n) for n, c in sums.items()), F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    part = F.when(F.col("power").isNotNull(), F.struct("power", *(F.col(c).cast("string").alias(c) for c in sums)))
    held = by.groupBy(*names).agg(F.collect_list(part).alias("parts"), F.sum("n").alias("count"), F.min("lo").alias("min"), F.max("hi").alias("max"))

    def add(parts: pd.Series) -> pd.DataFrame:
        from fractions import Fraction

        sums, squares = [], []
        for group in parts:
            s = q = Fraction(0)
            for p in group:
                unit = Fraction(2) ** p["power"]
                s += int(p["s"]) * unit
                if "hh" in p:
                    q += (int(p["hh"]) * 10**18 + 2 * int(p["hl"]) * 10**9 + int(p["ll"])) * unit * unit
            sums.append(_rounded(s))
            squares.append(_rounded(q))
        return pd.DataFrame({"sum": sums, "sumsqr": squares})

    def _rounded(f) -> float:
        try:
            return f.numerator / f.denominator
        except OverflowError:
            return float("inf")

    out = held.withColumn("added", F.pandas_udf(add, "sum double, sumsqr double")("parts"))
    keys = names if level else []
    if view.reducer == "_sum":
        return out.select(*keys, F.col("added.sum").alias("sum"))
    return out.select(*keys, "count", F.col("added.sum").alias("sum"), "min", "max", F.col("added.sumsqr").alias("sumsqr"))


def finite(df: DataFrame) -> DataFrame:
    """Raises resource_limit, when it runs, where an aggregate is no finite number."""
    for name, kind in df.dtypes:
        if kind == "double":
            bad = F.col(name).isin(float("inf"), float("-inf")) | F.isnan(name)
            df = df.withColumn(name, F.when(bad, F.raise_error(F.lit("resource_limit: an aggregate is too large")).cast("double")).otherwise(F.col(name)))
    return df


def query(docs: Documents, view: View, options: dict[str, Any] | None = None) -> DataFrame:
    """A view's rows in key order: map rows by key, then id; reduced ones by group key; limited if asked.

    An aggregate that is no finite number is a resource_limit. consistency (stale_ok, update_after or consistent) is
    checked, and makes no difference here, as rows are those of the documents as they are; `MaterializedView.query`
    is where it does."""
    options = dict(options or {})
    if options.get("consistency", "stale_ok") not in CONSISTENCY:
        raise invalid("consistency is one of " + ", ".join(CONSISTENCY))
    if not set(options) <= {"key", "start_key", "end_key", "inclusive_end", "group_level", "limit", "bookmark", "exact", "consistency"}:
        raise invalid("unknown options")
    df = ranged(rows(docs, view), view, options)
    if view.reducer is None:
        names = [f"key{n}" for n in range(len(view.key))] + ["id"]
    else:
        df = finite(reduced(df, view, options.get("group_level"), options.get("exact", True)))
        names = [c for c in df.columns if c.startswith("key")]
    if options.get("bookmark"):
        payload = bookmarks.read(options["bookmark"])
        bookmarks.check(payload, view.digest, docs.snapshot())
        key = [F.struct(F.lit(k["tag"]).alias("tag"), F.lit(k["num"]).cast("double").alias("num"), F.lit(k["str"]).cast("string").alias("str")) for k in payload["k"]]
        out, same = F.lit(False), F.lit(True)
        for name, k in zip(names, [*key, *([F.lit(payload["id"])] if view.reducer is None else [])], strict=True):
            out, same = out | (same & (F.col(name) > k)), same & (F.col(name) == k)
        df = df.where(out)
    if names:
        df = df.orderBy(*names)
    return df.limit(options["limit"]) if "limit" in options else df


def execute(docs: Documents, view: View, options: dict[str, Any] | None = None) -> dict[str, Any]:
    """A page of rows (at most limit), has_more and a bookmark."""
    options = dict(options or {})
    limit = options.pop("limit", LIMIT)
    if isinstance(limit, bool) or not isinstance(limit, int) or not 0 < limit <= MOST:
        raise invalid(f"limit must be 1 to {MOST}")
    held = query(docs, view, options | {"limit": limit + 1}).collect()
    more, held = len(held) > limit, held[:limit]
    mark = None
    if more:
        last = held[-1].asDict(recursive=True)
        names = sorted(k for k in last if k.startswith("key"))
        mark = bookmarks.encode({"f": view.digest, "v": docs.snapshot(), "k": [last[n] for n in names], "id": last.get("id")})
    return {"rows": held, "has_more": more, "bookmark": mark}


def key_value(c: str) -> Column:
    """A key component as JSON text."""
    k = F.col(c)
    return (
        F.when(k["tag"] == 0, "null").when(k["tag"] == 1, "false").when(k["tag"] == 2, "true").when(k["tag"] == 3, k["num"].cast("string")).otherwise(k["str"])
    )


class Catalog:
    """Named views and indexes of a database, and what keeps them: a full-text index's stored postings, a
    materialized view's contributions."""

    def __init__(self) -> None:
        self.views: dict[str, View] = {}
        self.indexes: dict[str, dict[str, Any]] = {}
        self.stores: dict[tuple[str, str], Any] = {}

    def list_views(self) -> list[dict[str, Any]]:
        """name, digest, reducer of each, by name, and whether it is stored, up to which sequence."""
        return [{"name": n, "digest": v.digest, "reducer": v.reducer} | self._stored("view", n) for n, v in sorted(self.views.items())]

    def list_indexes(self) -> list[dict[str, Any]]:
        return [i | self._stored("index", n) for n, i in sorted(self.indexes.items())]

    def _stored(self, kind: str, name: str) -> dict[str, Any]:
        store = self.stores.get((kind, name))
        return {"stored": store is not None, "sequence": store.versions.state().get("sequence") if store else None}

    def keep(self, kind: str, name: str, store: Any) -> None:
        """store: has `rebuild(docs, sequence)` and `versions`, as SearchIndex and MaterializedView do."""
        held = {"view": self.views, "index": self.indexes}[kind]
        if name not in held:
            raise EngineError(f"{kind}_not_found", f"no such {kind}", name=name)
        self.stores[kind, name] = store

    def rebuild(self, kind: str, name: str, docs: Documents, sequence: int) -> None:
        """A kept index or view anew from all documents, as one version. Others need none: they are their definition."""
        held = {"view": self.views, "index": self.indexes}[kind]
        if name not in held:
            raise EngineError(f"{kind}_not_found", f"no such {kind}", name=name)
        if (kind, name) in self.stores:
            self.stores[kind, name].rebuild(docs, sequence)

    def create_view(self, definition: dict[str, Any]) -> View:
        view = define(definition)
        if view.name in self.views:
            if self.views[view.name].digest != view.digest:
                raise EngineError("view_name_conflict", "another view has that name")
            return self.views[view.name]
        self.views[view.name] = view
        return view

    def drop_view(self, name: str) -> None:
        self.stores.pop(("view", name), None)
        if self.views.pop(name, None) is None:
            raise EngineError("view_not_found", "no such view")

    def create_index(self, index: dict[str, Any]) -> dict[str, Any]:
        if not isinstance(index, dict) or index.get("type") not in ("structured", "full_text") or not index.get("name") or not index.get("fields"):
            raise invalid("an index has a name, a type and fields")
        for f in index["fields"]:
            pointer.parse(f["path"] if isinstance(f, dict) else f)
        full = index | {"digest": digest({"type": index["type"], "fields": index["fields"]})}
        if index["name"] in self.indexes and self.indexes[index["name"]]["digest"] != full["digest"]:
            raise EngineError("index_name_conflict", "another index has that name")
        return self.indexes.setdefault(index["name"], full)

    def drop_index(self, name: str) -> None:
        self.stores.pop(("index", name), None)
        if self.indexes.pop(name, None) is None:
            raise EngineError("index_not_found", "no such index")
