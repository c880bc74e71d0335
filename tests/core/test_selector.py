"""Operator truth tables, on decoded documents and on both kinds of columns."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.errors import EngineError
from tessella.plans.binding import Documents
from tessella.plans.compile import truth
from tessella.plans.predicate import matches, parse

GONE = object()
#: What a buoy's log may have under one key.
READINGS = [GONE, None, True, False, 0, -6, 2.5, 14, "", "Tide", "tidal", "14", [], ["reef"], [14, "reef", 14], [None], {}, {"depth": 14}, {"depth": 14.0, "salt": None}]


def kind(v):
    return "gone" if v is GONE else "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def same(a, b):
    """Equal as JSON: of one kind, numbers by value, arrays and objects by their parts."""
    if kind(a) != kind(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def scalar(v):
    return v is not GONE and kind(v) not in ("array", "object")


def number(v):
    return kind(v) == "number"


def text(v):
    return kind(v) == "string"


def array(v):
    return kind(v) == "array"


#: Tests, and what they have to say of a reading, each from its rule.
RULES = [
    *(({"$eq": x}, lambda v, x=x: same(v, x)) for x in (None, False, 14, 2.5, "tidal", ["reef"], {"depth": 14})), ("Tide", lambda v: same(v, "Tide")), ({"depth": 14, "salt": None}, lambda v: same(v, {"depth": 14, "salt": None})),
    *(({"$ne": x}, lambda v, x=x: v is not GONE and not same(v, x)) for x in (None, 14, "", [])),
    ({"$gt": 0}, lambda v: number(v) and v > 0), ({"$gte": -6}, lambda v: number(v) and v >= -6), ({"$lt": 2.5}, lambda v: number(v) and v < 2.5), ({"$lte": 14}, lambda v: number(v) and v <= 14),
    ({"$gt": "14"}, lambda v: text(v) and v > "14"), ({"$lte": "Tide"}, lambda v: text(v) and v <= "Tide"),
    ({"$in": [None, "14", 2.5]}, lambda v: v is not GONE and any(same(v, x) for x in (None, "14", 2.5))), ({"$nin": [True, 14]}, lambda v: scalar(v) and not any(same(v, x) for x in (True, 14))),
    ({"$exists": True}, lambda v: v is not GONE), ({"$exists": False}, lambda v: v is GONE),
    ({"$beginsWith": "ti"}, lambda v: text(v) and v.startswith("ti")), ({"$regex": "[dD]"}, lambda v: text(v) and ("d" in v or "D" in v)), ({"$regex": "^$"}, lambda v: v == "" and text(v)),
    ({"$all": [14]}, lambda v: array(v) and any(same(14, x) for x in v)), ({"$all": ["reef", 14]}, lambda v: array(v) and any(same(14, x) for x in v) and any(same("reef", x) for x in v)), ({"$all": [None]}, lambda v: array(v) and None in v),
    ({"$size": 0}, lambda v: array(v) and not v), ({"$size": 3}, lambda v: array(v) and len(v) == 3),
    ({"$mod": [4, 2]}, lambda v: number(v) and v == int(v) and math.fmod(v, 4) == 2), ({"$mod": [4, -2]}, lambda v: number(v) and v == int(v) and math.fmod(v, 4) == -2), ({"$mod": [7, 0]}, lambda v: number(v) and v == int(v) and v % 7 == 0),
    *(({"$type": t}, lambda v, t=t: kind(v) == t) for t in ("null", "boolean", "number", "string", "array", "object")),
    ({"$gte": 0, "$lt": 14}, lambda v: number(v) and 0 <= v < 14), ({"$exists": True, "$type": "array", "$size": 1}, lambda v: array(v) and len(v) == 1),
]
#: Arrays of objects, for tests of one element.
CREW = [{"crew": [{"role": "mate", "age": 30}, {"role": "cook", "age": 51}]}, {"crew": [{"role": "cook"}, 7, "mate"]}, {"crew": []}, {"crew": {"role": "cook", "age": 51}}, {}]
ELEMENTS = [
    ({"/role": "cook"}, lambda x: x.get("role") == "cook"), ({"/role": "mate", "/age": {"$gt": 40}}, lambda x: x.get("role") == "mate" and x.get("age", 0) > 40), ({"/role": "cook", "/age": {"$gt": 40}}, lambda x: x.get("role") == "cook" and x.get("age", 0) > 40),
    ({"/age": {"$exists": False}}, lambda x: "age" not in x),
]


def spark_says(spark, pairs):
    """Truths of (selector, body) pairs on VARIANT bodies."""
    rows = [(n, json.dumps(body)) for n, (_, body) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("body", F.parse_json("text"))
    docs = Documents(df, "id", body="body")
    by = {}
    for n, (selector, _) in enumerate(pairs):
        by.setdefault(json.dumps(selector), (selector, []))[1].append(n)
    columns = [truth(parse(s), docs).alias(f"s{k}") for k, (s, _) in enumerate(by.values())]
    got = {r.id: r for r in df.select("id", *columns).collect()}
    return [got[n][f"s{k}"] for n in range(len(pairs)) for k, (_, those) in enumerate(by.values()) if n in those]


def test_every_operator_on_every_kind_of_value(spark):
    pairs, want = [], []
    for test, rule in RULES:
        for v in READINGS:
            pairs.append(({"/log/reading": test}, {"log": {} if v is GONE else {"reading": v}}))
            want.append(bool(rule(v)))
    for test, rule in ELEMENTS:
        for body in CREW:
            pairs.append(({"/crew": {"$elemMatch": test}}, body))
            want.append(isinstance(body.get("crew"), list) and any(isinstance(x, dict) and rule(x) for x in body["crew"]))
    assert [matches(parse(s), b) for s, b in pairs] == want
    assert spark_says(spark, pairs) == want


def test_combinations_and_pointers(spark):
    buoy = {"name": "N7", "at": [54.1, {"mark": "red"}], "3": {"3": "x"}, 'a"b': {"/~": 1}}
    cases = [
        ({}, True), ({"/name": "N7", "/at/0": {"$gt": 54}}, True), ({"$and": [{"/name": "N7"}, {"/at/0": 1}]}, False), ({"$or": [{"/none": 1}, {"/at/1/mark": "red"}]}, True), ({"$not": {"/none": 1}}, True),
        ({"$nor": [{"/name": "N7"}, {"/none": 1}]}, False), ({"$not": {"$nor": [{"/name": "N7"}]}}, True), ({"/3/3": "x"}, True), ({"/at/2": {"$exists": False}}, True), ({'/a"b/~1~0': 1}, True), ({"/at/mark": {"$exists": True}}, False),
    ]
    pairs = [(s, buoy) for s, _ in cases]
    assert [matches(parse(s), b) for s, b in pairs] == [w for _, w in cases]
    assert spark_says(spark, pairs) == [w for _, w in cases]


leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from([0.5, 2.0, -1.5]), st.sampled_from(["", "a", "ab", "é", "10"]))
value = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from("ab"), x, max_size=2)), max_leaves=4)
test_ = st.one_of(
    st.builds(lambda x: {"$eq": x}, value), st.builds(lambda x: {"$ne": x}, value), st.builds(lambda o, x: {o: x}, st.sampled_from(["$gt", "$gte", "$lt", "$lte"]), st.one_of(st.integers(-3, 3), st.sampled_from(["a", "b"]))),
    st.builds(lambda o, x: {o: x}, st.sampled_from(["$in", "$nin", "$all"]), st.lists(leaf, min_size=1, max_size=3)), st.builds(lambda x: {"$exists": x}, st.booleans()),
    st.builds(lambda x: {"$type": x}, st.sampled_from(["null", "number", "string", "boolean", "array", "object"])), st.builds(lambda x: {"$size": x}, st.integers(0, 2)), st.builds(lambda d, r: {"$mod": [d, r]}, st.sampled_from([2, 3, -2]), st.integers(-1, 1)),
)
selector = st.recursive(
    st.builds(lambda p, t: {p: t}, st.sampled_from(["/x", "/y", "/x/a", "/x/0"]), test_),
    lambda s: st.one_of(st.builds(lambda x: {"$not": x}, s), st.builds(lambda o, x: {o: x}, st.sampled_from(["$and", "$or", "$nor"]), st.lists(s, min_size=1, max_size=2)), st.builds(lambda x: {"/x": {"$elemMatch": x}}, s)),
    max_leaves=3,
)
body = st.dictionaries(st.sampled_from("xy"), value, max_size=2)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(selector, body), min_size=12, max_size=20))
def test_columns_agree_with_the_evaluator(spark, pairs):
    assert spark_says(spark, pairs) == [matches(parse(s), b) for s, b in pairs]


def test_typed_table(spark):
    df = spark.createDataFrame([(1, "a", 1.5, [1, 2]), (2, None, 10.0, None), (3, "abc", None, [])], "k int, s string, x double, a array<int>")
    bodies = [{"k": 1, "s": "a", "x": 1.5, "a": [1, 2]}, {"k": 2, "x": 10.0}, {"k": 3, "s": "abc", "a": []}]
    docs = Documents(df, "k")
    selectors = [
        {"/s": "a"}, {"/s": {"$ne": "a"}}, {"$not": {"/s": "a"}}, {"/s": {"$nin": ["a"]}}, {"/x": {"$gt": 2}}, {"/x": {"$gt": "2"}}, {"/s": {"$exists": False}},
        {"/a": {"$size": 0}}, {"/a": {"$all": [1]}}, {"/a/1": 2}, {"/nope": 1}, {"/nope": {"$exists": False}}, {"/k": {"$mod": [2, 1]}}, {"/s": {"$beginsWith": "ab"}},
        {"/s": {"$regex": "b"}}, {"/x": {"$type": "number"}}, {"/s": {"$in": [1, "abc"]}}, {"$nor": [{"/x": {"$lt": 2}}, {"/s": "abc"}]}, {"/a": [1, 2]}, {"/x": {"$ne": "1"}},
    ]
    for s in selectors:
        p = parse(s)
        want = [b["k"] for b in bodies if matches(p, b)]
        assert [r.k for r in df.where(truth(p, docs)).orderBy("k").collect()] == want, s


@pytest.mark.parametrize(
    "bad",
    [
        {"": 1}, {"x": 1}, {"/x": {"$foo": 1}}, {"/x": {"$gt": None}}, {"/x": {"$in": []}}, {"/x": {"$in": [[1]]}}, {"/x": {"$size": -1}}, {"/x": {"$size": True}}, {"/x": {"$mod": [0, 1]}},
        {"/x": {"$regex": "(?i)a"}}, {"/x": {"$regex": "("}}, {"/x": {"$regex": "a" * 1025}}, {"/x": {"$eq": 1, "a": 2}}, {"$and": []}, {"$or": [{}] * 65}, {"/x": 2**53}, {"/x": {"$type": "int"}},
        {"/x": {"$beginsWith": ""}}, {"/x": {"$exists": 1}}, {"/x~2": 1}, [], {"$not": 3},
    ],
)
def test_bad_selectors(bad):
    with pytest.raises(EngineError) as e:
        parse(bad)
    assert e.value.code == "invalid_request"


def test_limits():
    s = {"/x": 1}
    for _ in range(40):
        s = {"$not": s}
    with pytest.raises(EngineError):
        parse(s)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    p = parse({"/o_orderstatus": "F", "$not": {"/o_totalprice": {"$gt": 100000.0}}})
    from tessella.plans.compile import condition

    plan = df.where(condition(p, Documents(df, "o_orderkey")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "LessThanOrEqual(o_totalprice,100000.0)" in plan
