"""Subscriptions and materialized views, as batches and as streams."""

import json

import pytest

from tessella.errors import EngineError
from tessella.operators import views
from tessella.plans.binding import Documents
from tessella.sources import documents as source
from tessella.streaming import subscription
from tessella.streaming.materialized import MaterializedView, group_id, map_id

LOG = "sequence long, id string, revision string, deleted boolean, body string"


def change(seq, id, body, deleted=False):
    return (seq, id, f"{seq}-x", deleted, None if body is None else json.dumps(body))


CHANGES = [change(1, "a", {"k": "x", "v": 1}), change(2, "b", {"k": "y", "v": 5}), change(3, "a", {"k": "y", "v": 2}), change(4, "c", {"k": "x", "v": 7}), change(5, "b", None, True), change(6, "a", {"k": "x", "v": 9}), change(7, "d", {"q": 1})]
WANTED = [("upsert", 1, "a"), ("remove", 3, "a"), ("upsert", 4, "c"), ("upsert", 6, "a")]


def test_transitions(spark):
    df = spark.createDataFrame(CHANGES, LOG)
    from pyspark.sql import functions as F

    docs = Documents(df.withColumn("v", F.try_parse_json("body")), "id", body="v")
    got = subscription.transitions(docs, {"/k": "x"}, "sequence", "deleted").orderBy("sequence").collect()
    assert [tuple(r) for r in got] == WANTED
    members = spark.createDataFrame([("b",)], "id string")
    got = subscription.transitions(docs, {"/k": "x"}, "sequence", "deleted", members).orderBy("sequence").collect()
    assert [tuple(r) for r in got] == sorted([*WANTED, ("remove", 2, "b")], key=lambda x: x[1])
    assert {r.id for r in subscription.members_after(docs, {"/k": "x"}, "sequence", "deleted").collect()} == {"a", "c"}


def test_stream_of_changes(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (CHANGES[:3], CHANGES[3:]):
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(path)
            events = subscription.stateful(subscription.follow(spark, path, LOG), {"/k": "x"})
            subscription.publish(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = spark.read.schema(subscription.EVENTS).json(str(tmp_path / "out")).orderBy("sequence").collect()
    assert [(r.event_type, r.sequence, r.id) for r in got] == WANTED


def test_snapshot(spark):
    docs = source.variants(spark.createDataFrame([(r[1], r[4]) for r in CHANGES[:4]][1:], "id string, body string"), "id", "body")
    got = subscription.snapshot(docs, {"selector": {"/k": "x"}, "fields": ["/v"]}).collect()
    assert [(r.id, r.fields, r.event_type) for r in got] == [("c", {"/v": "7"}, "snapshot")]
    with pytest.raises(EngineError) as e:
        subscription.snapshot(docs, {"selector": {}}, members=2)
    assert e.value.code == "resource_limit"
    with pytest.raises(EngineError):
        subscription.snapshot(docs, {"selector": {}, "limit": 3})


DEFINITION = {"name": "mv", "key": [{"path": "/k"}], "value": {"path": "/v"}, "reducer": "_stats"}


def values(view):
    return {r.id: json.loads(r.body) for r in view.documents().collect()}


def test_materialized_view(spark, tmp_path):
    from pyspark.sql import functions as F

    log = spark.createDataFrame(CHANGES, LOG).withColumn("_v", F.try_parse_json("body"))
    view = MaterializedView(spark, str(tmp_path / "mv"), DEFINITION, group_level=1)
    assert view.documents().count() == 0
    view.apply(Documents(log.where("sequence <= 3"), "id", body="_v"), 3, "deleted", "sequence", expected=0)
    assert values(view)[group_id(["y"])] == {"key": ["y"], "value": {"count": 2, "sum": 7, "min": 2, "max": 5, "sumsqr": 29}} and len(values(view)) == 1
    before = view.documents().cache()
    before.count()
    with pytest.raises(EngineError) as e:
        view.apply(Documents(log, "id", body="_v"), 9, "deleted", "sequence", expected=7)
    assert e.value.code == "checkpoint_conflict"
    groups = view.apply(Documents(log.where("sequence > 3"), "id", body="_v"), 7, "deleted", "sequence", expected=3)
    assert {r.key0.str for r in groups.collect()} == {"x", "y"}
    assert view.apply(Documents(log, "id", body="_v"), 7, "deleted", "sequence") is None
    assert values(view) == {group_id(["x"]): {"key": ["x"], "value": {"count": 2, "sum": 16, "min": 7, "max": 9, "sumsqr": 130}}}
    actions = {r.id: r.action for r in view.changed(before).collect()}
    assert actions == {group_id(["x"]): "put", group_id(["y"]): "delete"}
    again = MaterializedView(spark, str(tmp_path / "again"), DEFINITION, group_level=1)
    last = log.groupBy("id").agg(F.max_by(F.struct("deleted", "_v"), "sequence").alias("c")).select("id", "c.*").where("not deleted")
    again.rebuild(Documents(last, "id", body="_v"), 7)
    assert values(again) == values(view) and again.state()["sequence"] == 7
    with pytest.raises(EngineError) as e:
        view.apply(Documents(log, "id", body="_v"), 9, epoch="new") if view.state()["epoch"] else _reset(view, log)
    assert e.value.code == "source_history_reset"


def _reset(view, log):
    state = view.state()
    view.versions.point(state | {"epoch": "old", "version": state["version"] + 1})
    view.apply(Documents(log, "id", body="_v"), 9, epoch="new")


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    view = MaterializedView(spark, str(tmp_path / "mv"), DEFINITION, group_level=1)
    view.rebuild(Documents(docs, "id"), 1)
    batch = docs.where("v % 100 = 0").withColumn("v", F.lit(10**6))
    for n in range(2, 5):
        view.apply(Documents(batch, "id"), n)
    layers = view.state()["layers"]
    assert [x["rows"] for x in layers] == [5000, 50, 50, 50]
    now = docs.withColumn("v", F.when(F.col("v") % 100 == 0, 10**6).otherwise(F.col("v")))
    again = MaterializedView(spark, str(tmp_path / "again"), DEFINITION, group_level=1)
    again.rebuild(Documents(now, "id"), 4)
    assert values(view) == values(again)
    view.apply(Documents(docs.where("v < 3000"), "id"), 5)  # more than half: a new base
    assert len(view.state()["layers"]) == 1 and view.contributions().count() == 5000
    view.versions.drop_old()
    assert view.contributions().count() == 5000


def test_a_crash_or_another_writer_loses_nothing(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, k string, v int")
    view = MaterializedView(spark, str(tmp_path / "mv"), DEFINITION, group_level=1)
    view.rebuild(Documents(docs, "id"), 1)
    held = values(view)
    changed = Documents(spark.createDataFrame([("a", "y", 9)], docs.schema), "id")

    def fails(state):
        raise OSError("the driver dies before the pointer is there")

    with monkeypatch.context() as m:
        m.setattr(view.versions, "point", fails)
        with pytest.raises(OSError):
            view.apply(changed, 2)
    assert values(view) == held and view.state()["sequence"] == 1
    other, before = MaterializedView(spark, str(tmp_path / "mv"), DEFINITION, group_level=1), view.versions.state()
    view.apply(changed, 2)
    with monkeypatch.context() as m:  # another writer that began before
        m.setattr(other.versions, "state", lambda: before)
        with pytest.raises(EngineError) as e:
            other.versions.append(view.contributions(), docs.select("id"), sequence=2, epoch=None)
        assert e.value.code == "checkpoint_conflict"
    assert values(other) == values(view) == {group_id(["y"]): {"key": ["y"], "value": {"count": 2, "sum": 11, "min": 2, "max": 9, "sumsqr": 85}}}


def test_consistency_of_a_materialized_view(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x", 1)], "id string, k string, v int")
    view = MaterializedView(spark, str(tmp_path / "mv"), DEFINITION, group_level=1)
    view.rebuild(Documents(docs, "id"), 1)
    update = lambda: view.apply(Documents(spark.createDataFrame([("b", "x", 5)], docs.schema), "id"), 2)
    count = lambda df: json.loads(df.first().body)["value"]["count"]
    assert count(view.query()) == 1
    with pytest.raises(EngineError) as e:
        view.query("consistent", 2)
    assert e.value.code == "view_not_caught_up"
    assert count(view.query("update_after", update=update)) == 1 and view.state()["sequence"] == 2
    assert count(view.query("consistent", 2, update)) == 2
    for bad in (("sometimes", 1), ("consistent", None)):
        with pytest.raises(EngineError):
            view.query(*bad)


def test_events_end_with_caught_up(spark):
    from pyspark.sql import functions as F

    log = spark.createDataFrame(CHANGES, LOG).withColumn("v", F.try_parse_json("body"))
    now = log.groupBy("id").agg(F.max_by(F.struct("deleted", "v"), "sequence").alias("c")).select("id", "c.*").where("not deleted")
    docs, history = Documents(now, "id", body="v"), Documents(log, "id", body="v")
    got = lambda cursor, **more: [(r.event_type, r.sequence, r.id) for r in subscription.events(docs, history, {"selector": {"/k": "x"}}, cursor, "sequence", deleted="deleted", **more).collect()]
    members = [("snapshot", None, "a"), ("snapshot", None, "c")]
    assert got(None) == [*members, ("caught_up", 7, None)]
    assert got(0) == [*WANTED, ("caught_up", 7, None)] and got(4) == [("upsert", 6, "a"), ("caught_up", 7, None)]
    assert got(2, floor=5) == [("reset", 5, None), *members, ("caught_up", 7, None)]
    assert subscription.error_event(EngineError("history_truncated", "gone")) == {"event_type": "error", "code": "history_truncated", "message": "gone", "retryable": False}


def test_map_only_view_follows_a_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    view = MaterializedView(spark, str(tmp_path / "mv"), {"name": "m", "key": [{"path": "/k"}], "value": {"path": "/v"}}, source="src")
    for part in (CHANGES[:4], CHANGES[4:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(path)
        view.follow(subscription.follow(spark, path, LOG), str(tmp_path / "cp"), "id", "body", "sequence", "deleted").awaitTermination(120)
    assert values(view) == {map_id("src", i): {"key": ["x"], "source_database_uuid": "src", "source_document_id": i, "value": v} for i, v in (("a", 9), ("c", 7))}
    with pytest.raises(EngineError):
        MaterializedView(spark, str(tmp_path / "x"), DEFINITION)
    with pytest.raises(EngineError):
        MaterializedView(spark, str(tmp_path / "x"), {"name": "m", "key": []}, group_level=0)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    open(path, "w").write('{"id": "a", "x": 1}\n{"id": "b", "x": 1, "x": 2}\nnot json\n{"id": "c"}\n')
    docs = source.json_lines(spark, path)
    assert {r.id for r in docs.df.collect()} == {"a", "c"} and source.rejected(spark, path).count() == 2
    source.write_json(docs, str(tmp_path / "out"))
    assert {r.id for r in source.json_lines(spark, str(tmp_path / "out")).df.collect()} == {"a", "c"}
    for name, data in (("one", b"1"), ("two", b"22")):
        open(tmp_path / f"{name}.bin", "wb").write(data)
    files = source.attachments(spark, str(tmp_path / "*.bin"))
    kept = files.where("length = 1").select("digest")
    assert [r.length for r in source.unreferenced(files, kept).collect()] == [2] and source.damaged(files).count() == 0
    assert views.define({"name": "v", "key": []}).reducer is None
