"""How pointers reach columns: documents as a VARIANT body, or tables whose columns are fields.

A Value stands for what lies at a pointer. Its tests are true, false or NULL, where NULL counts as
false: missing and of the wrong type. So conjunctions and disjunctions stay plain, and those of a
typed table reach the Parquet scan; only negation (`tessella.plans.compile`) and results need more.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import invalid
from tessella.functions.canonical import digest
from tessella.functions.pointer import is_index
from tessella.plans.predicate import SAFE, type_of

NEVER = F.lit


class Value:
    """Tests of a value; see the two kinds."""

    def in_(self, operands: tuple) -> Column:
        tests = [self.eq(x) for x in operands]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out


class VariantValue(Value):
    """A VARIANT column; SQL NULL is missing."""

    def __init__(self, v: Column):
        self.v = v
        self.kind = F.schema_of_variant(v)

    def get(self, tokens: tuple[str, ...]) -> VariantValue:
        v, path = self.v, "$"
        for t in tokens:
            if is_index(t):  # an object's key or an array's place
                v = v if path == "$" else F.try_variant_get(v, path, "variant")
                v, path = F.coalesce(F.try_variant_get(v, f'$["{t}"]', "variant"), F.try_variant_get(v, f"$[{t}]", "variant")), "$"
            elif '"' in t or "\\" in t:
                v = v if path == "$" else F.try_variant_get(v, path, "variant")
                v, path = F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(t)), "$"
            else:
                path += f'["{t}"]'
        return VariantValue(v if path == "$" else F.try_variant_get(v, path, "variant"))

    def exists(self) -> Column:
        return self.v.isNotNull()

    def is_type(self, name: str) -> Column:
        if name == "null":
            return F.is_variant_null(self.v) & self.v.isNotNull()
        if name == "number":
            return self.kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | self.kind.startswith("DECIMAL")
        return self.kind.startswith({"boolean": "BOOLEAN", "string": "STRING", "array": "ARRAY", "object": "OBJECT"}[name])

    def number(self) -> Column:
        return F.when(self.is_type("number"), F.try_variant_get(self.v, "$", "double"))

    def string(self) -> Column:
        return F.when(self.is_type("string"), F.try_variant_get(self.v, "$", "string"))

    def boolean(self) -> Column:
        return F.when(self.is_type("boolean"), F.try_variant_get(self.v, "$", "boolean"))

    def scalar(self) -> Column:
        return ~(self.is_type("array") | self.is_type("object"))

    def json(self) -> Column:
        return F.to_json(self.v)

    def eq(self, x: Any) -> Column:
        kind = type_of(x)
        if kind == "null":
            return self.is_type("null")
        if kind == "number":
            return self.number() == F.lit(float(x))
        if kind == "string":
            return self.string() == F.lit(x)
        if kind == "boolean":
            return self.boolean() == F.lit(x)
        if kind == "array":
            out = self.size() == len(x)
            for n, y in enumerate(x):
                out = out & F.coalesce(VariantValue(F.try_variant_get(self.v, f"$[{n}]", "variant")).eq(y), F.lit(False))
            return out
        out = F.when(self.is_type("object"), F.size(F.map_keys(F.try_variant_get(self.v, "$", "map<string,variant>"))) == len(x))
        for k, y in x.items():
            out = out & F.coalesce(VariantValue(F.element_at(F.try_variant_get(self.v, "$", "map<string,variant>"), F.lit(k))).eq(y), F.lit(False))
        return out

    def ne(self, x: Any) -> Column:
        return self.exists() & ~F.coalesce(self.eq(x), F.lit(False))

    def nin(self, x: tuple) -> Column:
        return self.exists() & self.scalar() & ~F.coalesce(self.in_(x), F.lit(False))

    def elements(self) -> Column:
        return F.when(self.is_type("array"), F.try_variant_get(self.v, "$", "array<variant>"))

    def size(self) -> Column:
        return F.size(self.elements())

    def any_element(self, test: Callable[[Value], Column]) -> Column:
        return F.exists(self.elements(), lambda e: F.coalesce(test(VariantValue(e)), F.lit(False)))

    def sort_key(self) -> Column:
        """missing, then numbers, false, null, true, objects, arrays, strings."""
        rank = (
            F.when(self.is_type("number"), 0)
            .when(self.boolean() == F.lit(False), 1)
            .when(self.is_type("null"), 2)
            .when(self.boolean(), 3)
            .when(self.is_type("object"), 4)
            .when(self.is_type("array"), 5)
            .otherwise(6)
        )
        text = F.coalesce(self.string(), F.when(~self.scalar(), self.json()))
        missing = self.v.isNull()
        return F.struct(missing.cast("int").alias("missing"), F.when(missing, -1).otherwise(rank).alias("rank"), self.number().alias("num"), text.alias("str"))

    def key(self) -> Column:
        """A view key's component; NULL where it is missing or no scalar."""
        tag = F.when(self.is_type("null"), 0).when(self.boolean() == F.lit(False), 1).when(self.boolean(), 2).when(self.is_type("number"), 3).when(self.is_type("string"), 4)
        return F.when(tag.isNotNull(), F.struct(tag.alias("tag"), (self.number() + F.lit(0.0)).alias("num"), self.string().alias("str")))


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class TypedValue(Value):
    """A column of a known type; SQL NULL is missing, or null if the binding says so."""

    def __init__(self, c: Column | None, kind: T.DataType | None, null: bool = False):
        if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            c, kind = c.cast("string"), T.StringType()
        self.c, self.t, self.null = c, kind, null
        self.name = (
            None if kind is None
            else "number" if isinstance(kind, NUMBERS)
            else "string" if isinstance(kind, T.StringType)
            else "boolean" if isinstance(kind, T.BooleanType)
            else "array" if isinstance(kind, T.ArrayType)
            else "object" if isinstance(kind, (T.StructType, T.MapType))
            else "variant" if isinstance(kind, T.VariantType)
            else "other"
        )

    def get(self, tokens: tuple[str, ...]) -> Value:
        if self.name == "variant":
            return VariantValue(self.c).get(tokens)
        if not tokens or self.c is None:
            return self
        t, rest = tokens[0], tokens[1:]
        if isinstance(self.t, T.StructType) and t in self.t.names:
            return TypedValue(self.c.getField(t), self.t[t].dataType, self.null).get(rest)
        if isinstance(self.t, T.MapType):
            return TypedValue(F.try_element_at(self.c, F.lit(t)), self.t.valueType, self.null).get(rest)
        if isinstance(self.t, T.ArrayType) and is_index(t):
            return TypedValue(F.get(self.c, F.lit(int(t))), self.t.elementType, self.null).get(rest)
        return TypedValue(None, None)

    def _none(self) -> Column:
        return F.lit(None).cast("boolean")

    def exists(self) -> Column:
        return F.lit(False) if self.c is None else F.lit(True) if self.null else self.c.isNotNull()

    def is_type(self, name: str) -> Column:
        if self.c is None:
            return F.lit(False)
        if name == "null":
            return self.c.isNull() if self.null else F.lit(False)
        return self.c.isNotNull() if name == self.name else F.lit(False)

    def number(self) -> Column:
        return self.c.cast("double") if self.name == "number" else F.lit(None).cast("double")

    def string(self) -> Column:
        return self.c if self.name == "string" else F.lit(None).cast("string")

    def boolean(self) -> Column:
        return self.c if self.name == "boolean" else self._none()

    def scalar(self) -> Column:
        return F.lit(self.name not in ("array", "object"))

    def json(self) -> Column:
        return self.c.cast("string") if self.name in ("number", "boolean") else F.to_json(self.c) if self.name in ("array", "object") else F.to_json(F.struct(self.c.alias("x")))

    def eq(self, x: Any) -> Column:
        kind = type_of(x)
        if kind == "null":
            return self.is_type("null")
        if kind != self.name:
            return F.lit(False)
        if kind == "array":
            parts = [self.size() == len(x)] + [TypedValue(F.get(self.c, F.lit(n)), self.t.elementType, True).eq(y) for n, y in enumerate(x)]
        elif kind == "object" and isinstance(self.t, T.StructType):
            if not set(x) <= set(self.t.names):
                return F.lit(False)
            parts = [self.c.isNotNull()] + [(F.coalesce(TypedValue(self.c.getField(k), self.t[k].dataType, self.null).eq(x[k]), F.lit(False)) if k in x else self.c.getField(k).isNull()) for k in self.t.names]
        elif kind == "object":
            parts = [F.size(self.c) == len(x)] + [F.coalesce(TypedValue(F.try_element_at(self.c, F.lit(k)), self.t.valueType, True).eq(y), F.lit(False)) for k, y in x.items()]
        else:
            return self.c == F.lit(x)
        out = parts[0]
        for p in parts[1:]:
            out = out & F.coalesce(p, F.lit(False))
        return out

    def ne(self, x: Any) -> Column:
        if self.name == type_of(x) and self.name in ("number", "string", "boolean") and not self.null:
            return self.c != F.lit(x)  # NULL, so false, where missing
        return self.exists() & ~F.coalesce(self.eq(x), F.lit(False))

    def in_(self, operands: tuple) -> Column:
        same = [x for x in operands if type_of(x) == self.name]
        rest = F.lit(False) if None not in operands else self.is_type("null")
        return (self.c.isin(*same) | rest) if same and None in operands else self.c.isin(*same) if same else rest

    def nin(self, x: tuple) -> Column:
        if self.c is None or self.name in ("array", "object"):
            return F.lit(False)
        same = [y for y in x if type_of(y) == self.name]
        if not self.null:
            return ~self.c.isin(*same) if same else self.c.isNotNull()
        return ~F.coalesce(self.in_(x), F.lit(False))

    def elements(self) -> Column:
        return self.c if self.name == "array" else F.lit(None).cast("array<string>")

    def size(self) -> Column:
        return F.when(self.c.isNotNull(), F.size(self.c)) if self.name == "array" else F.lit(None).cast("int")

    def any_element(self, test: Callable[[Value], Column]) -> Column:
        if self.name != "array":
            return F.lit(False)
        return F.exists(self.c, lambda e: F.coalesce(test(TypedValue(e, self.t.elementType, True)), F.lit(False)))

    def sort_key(self) -> Column:
        return self.c if self.c is not None else F.lit(None).cast("string")

    def key(self) -> Column:
        tag = {"number": F.lit(3), "string": F.lit(4), "boolean": F.when(self.c, 2).otherwise(1) if self.name == "boolean" else None}.get(self.name)
        if tag is None:
            return F.lit(None).cast("struct<tag:int,num:double,str:string>")
        whole = F.struct(tag.alias("tag"), self.number().alias("num"), self.string().alias("str"))
        if self.null:
            return F.when(self.c.isNull(), F.struct(F.lit(0).alias("tag"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str"))).otherwise(whole)
        return F.when(self.c.isNotNull(), whole)


@dataclass
class Documents:
    """A set of documents: a DataFrame and how it is addressed.

    body: the VARIANT column that holds the document; or None, and then the columns are its fields.
    id: the column with the document's id. json: string columns that hold JSON. null: SQL NULL means null
    rather than missing. version: what a bookmark is bound to, such as the largest change sequence; if none is
    given, it follows from the files that the data are read from (`snapshot`).
    """

    df: DataFrame
    id: str
    body: str | None = None
    revision: str | None = None
    json: tuple[str, ...] = ()
    null: bool = False
    version: str | None = None
    name: str = ""
    extra: dict[str, Any] = field(default_factory=dict)

    def at(self, tokens: tuple[str, ...]) -> Value:
        """The value at a pointer; a typed table has no value at the empty one."""
        if self.body:
            return VariantValue(F.col(self.body)).get(tokens)
        if not tokens:
            raise invalid("a table has no whole document")
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        if tokens[0] not in kinds:
            return TypedValue(None, None)
        c = F.col(f"`{tokens[0]}`")
        if tokens[0] in self.json:
            return VariantValue(F.try_parse_json(c)).get(tokens[1:]) if len(tokens) > 1 else VariantValue(F.try_parse_json(c))
        return TypedValue(c, kinds[tokens[0]], self.null).get(tokens[1:])

    def id_column(self) -> Column:
        return F.col(f"`{self.id}`").cast("string")

    def among(self, ids: list[str]) -> Column:
        """Whether the id is one of these, as a filter that the scan can use: they are turned into the column's
        type. Of a number, an id is its shortest decimal form."""
        kind = self.df.schema[self.id].dataType
        c = F.col(f"`{self.id}`")
        if isinstance(kind, T.StringType):
            return c.isin(*ids)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
            whole = [int(i) for i in ids if re.fullmatch("0|-?[1-9][0-9]*", i)]
            whole = [n for n in whole if -(1 << bits - 1) <= n < 1 << bits - 1]
            return c.isin(*whole) if whole else F.lit(False)
        return self.id_column().isin(*ids)

    def snapshot(self) -> str:
        """What state of the data this is: the version given, or a digest of the names, lengths and times of the files
        read; "0" for data that are in no file."""
        if self.version is None:
            spark, files = self.df.sparkSession, sorted(self.df.inputFiles())
            seen = []
            for f in files:
                at = spark._jvm.org.apache.hadoop.fs.Path(f)
                status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
                seen.append([f, str(status.getLen()), str(status.getModificationTime())])
            self.version = digest(seen) if seen else "0"
        return self.version


def integral(v: Value) -> Column:
    """The value as a whole number that binary64 holds exactly; else NULL."""
    x = v.number()
    return F.when((x == F.floor(x)) & (F.abs(x) <= SAFE), x.try_cast("bigint"))
