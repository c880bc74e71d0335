"""Predicates as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.plans.binding import Documents, Value, VariantValue, integral
from tessella.plans.predicate import Both, Either, Everything, Field, Negated, Predicate, type_of


def condition(p: Predicate, docs: Documents) -> Column:
    """True where a document matches; false or NULL elsewhere, so use it in a filter."""
    return _compile(p, docs.at)


def truth(p: Predicate, docs: Documents) -> Column:
    """Whether a document matches, as a column without NULLs."""
    return F.coalesce(condition(p, docs), F.lit(False))


def _compile(p: Predicate, at) -> Column:
    if isinstance(p, Everything):
        return F.lit(True)
    if isinstance(p, Both):
        return reduce(lambda a, b: a & b, (_compile(x, at) for x in p.parts))
    if isinstance(p, Either):
        return reduce(lambda a, b: a | b, (_compile(x, at) for x in p.parts))
    if isinstance(p, Negated):
        inner = _compile(p.part, at)
        return inner.isNull() | ~inner  # unlike coalesce, this still reaches the scan
    return _test(p, at(p.tokens))


def _test(p: Field, v: Value) -> Column:
    op, x = p.op, p.operand
    if op == "eq":
        return v.eq(x)
    if op == "ne":
        return v.ne(x)
    if op in ("gt", "gte", "lt", "lte"):
        if type_of(x) == "number":
            plain = getattr(v, "c", None)
            left = plain if plain is not None and getattr(v, "name", "") == "number" else v.number()
        else:
            left = v.string()
        return {"gt": left > x, "gte": left >= x, "lt": left < x, "lte": left <= x}[op]
    if op == "in":
        return v.in_(x)
    if op == "nin":
        return v.nin(x)
    if op == "exists":
        return v.exists() if x else ~v.exists()
    if op == "type":
        return v.is_type(x)
    if op == "beginsWith":
        return v.string().startswith(x)
    if op == "regex":
        return v.string().rlike(x)
    if op == "all":
        return reduce(lambda a, b: a & b, (v.any_element(lambda e, y=y: e.eq(y)) for y in x))
    if op == "elemMatch":
        return v.any_element(lambda e: e.is_type("object") & _compile(x, e.get))
    if op == "size":
        return v.size() == x
    if op == "mod":
        return integral(v) % x[0] == x[1]
    raise AssertionError(op)


__all__ = ["VariantValue", "condition", "truth"]
