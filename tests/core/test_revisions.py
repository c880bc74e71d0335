"""Revision trees, changes, replication, retention, integrity, canonical JSON."""

import hashlib
import json
import math
import struct
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.errors import EngineError
from tessella.functions.canonical import canonical, decode, number, revision_id
from tessella.operators import changes, revisions

REV = "document_id string, revision_id string, parent_revision string, history_id string, deleted boolean, body string"
H = "11111111-1111-4111-8111-111111111111"


def chain(doc, n, parent=None, mark="", deleted_last=False):
    out = []
    for k in range(n):
        gone = deleted_last and k == n - 1
        body = None if gone else {"n": k, "mark": mark}
        rid = revision_id(doc, H, parent, gone, body)
        out.append((doc, rid, parent, H, gone, None if gone else canonical(body)))
        parent = rid
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, REV)


def model(rows):
    """Leaves and winner of each document, plainly."""
    out = {}
    for doc in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == doc]
        parents = {r[2] for r in mine}
        leaves = [r for r in mine if r[1] not in parents]
        winner = max(leaves, key=lambda r: (not r[4], int(r[1].split("-")[0]), r[1].split("-")[1]))
        out[doc] = {r[1] for r in leaves}, winner[1], sorted(r[1] for r in leaves if not r[4] and r[1] != winner[1])
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 3), st.integers(0, 4), st.booleans(), st.booleans()), min_size=1, max_size=8))
def test_winners_are_the_models(spark, shapes):
    rows = []
    for d, (n, branch, at, dead, dead2) in enumerate(shapes):
        trunk = chain(f"d{d}", n, deleted_last=dead and n > 1)
        rows += trunk
        if branch:
            rows += chain(f"d{d}", branch, trunk[min(at, n - 1)][1] if not trunk[min(at, n - 1)][4] else None, "b", dead2 and branch > 1)
    df, want = frame(spark, rows), model(rows)
    assert {r.document_id: r.revision_id for r in revisions.winners(df).collect()} == {d: w for d, (_, w, _) in want.items()}
    leaves = {}
    for r in revisions.leaves(df).collect():
        leaves.setdefault(r.document_id, set()).add(r.revision_id)
    assert leaves == {d: s for d, (s, _, _) in want.items()}
    assert {r.document_id: r.conflicts for r in revisions.conflicts(df).collect()} == {d: c for d, (_, _, c) in want.items() if c}


def test_writes(spark):
    empty = frame(spark, [])
    df, out = revisions.write(empty, [{"id": "a", "body": {"x": 1}, "history_id": H}, {"id": "b", "body": {}, "history_id": H}])
    assert out[1]["revision"] == "1-" + revision_id("b", H, None, False, {}).split("-")[1]
    first = out[0]["revision"]
    df, out = revisions.write(df, [{"id": "a", "body": {"x": 1}}])
    assert out[0]["replayed"] and df.count() == 2
    df, out = revisions.write(df, [{"id": "a", "body": {"x": 2}, "if_revision": first}, {"id": "b", "delete": True, "if_revision": revision_id("b", H, None, False, {})}])
    assert [r["revision"].split("-")[0] for r in out] == ["2", "2"]
    assert {r.document_id for r in revisions.documents(df).collect()} == {"a"}
    for bad in ({"id": "a", "body": {"x": 3}}, {"id": "a", "body": {}, "if_revision": first}, {"id": "b", "body": {}}):
        with pytest.raises(EngineError) as e:
            revisions.write(df, [{"id": "c", "body": {}}, bad])
        assert e.value.code == "revision_conflict"
    df2, _ = revisions.write(df, [{"id": "b", "body": {"again": 1}, "if_revision": out[1]["revision"]}])
    assert {r.document_id for r in revisions.documents(df2).collect()} == {"a", "b"}
    assert revisions.write(df, [{"id": "a", "body": 1}, {"id": "c", "body": {}}], atomic=False)[1][0] == {"id": "a", "error": "revision_conflict"}


def test_conflicts_are_resolved(spark):
    trunk = chain("d", 2)
    rows = trunk + chain("d", 1, trunk[0][1], "other")
    df = frame(spark, rows)
    live = sorted({r[1] for r in rows} - {trunk[0][1]})
    done = revisions.resolve(df, "d", live, live[0])
    assert revisions.conflicts(done).count() == 0 and revisions.winners(done).first().parent_revision == live[0]
    with pytest.raises(EngineError):
        revisions.resolve(df, "d", live[:1], live[0])


def test_transfer(spark):
    rows = chain("a", 4) + chain("b", 2) + chain("c", 3, deleted_last=True)
    ours, theirs = frame(spark, rows[:2]), frame(spark, rows)
    assert {r.revision_id for r in revisions.missing(theirs, ours).collect()} == {r[1] for r in rows[2:]}
    merged = revisions.merge(ours, theirs)
    assert merged.count() == len(rows) and revisions.merge(merged, theirs).count() == len(rows)
    with pytest.raises(EngineError):
        revisions.merge(ours, frame(spark, rows[3:4]))
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sequence long, document_id string")
    got, at = changes.replicate(theirs, ours, log, 1)
    assert at == 3 and {r.document_id for r in got.collect()} == {"a", "b", "c"} and revisions.missing(theirs.where("document_id <> 'a'"), got).count() == 0
    assert changes.replicate(theirs, got, log, at)[1] == 3
    walked = revisions.chains(theirs, frame(spark, rows[3:4]).select("document_id", "revision_id")).collect()
    assert [r.revision_id for r in walked] == [r[1] for r in rows[:4]]


def test_retention(spark):
    rows = chain("a", 4) + chain("b", 5) + chain("gone", 3, deleted_last=True) + chain("new", 4)
    df = frame(spark, rows)
    latest = spark.createDataFrame([("a", 5), ("b", 6), ("gone", 7), ("new", 50)], "document_id string, sequence long")
    removed = lambda depth: {(r.document_id, r.reason): 0 for r in []} or [(r.document_id, r.revision_id, r.reason) for r in revisions.compaction(df, latest, 10, depth).collect()]
    assert sorted(removed(0)) == sorted([(d, r, "superseded") for d, r, *_ in rows[:3] + rows[4:8]] + [(d, r, "retired") for d, r, *_ in rows[9:12]])
    assert sorted(removed(2)) == sorted([(d, r, "superseded") for d, r, *_ in rows[:1] + rows[4:6]] + [(d, r, "retired") for d, r, *_ in rows[9:12]])
    peers = spark.createDataFrame([(40, None), (30, 100), (5, 1)], "safe_sequence long, expires_ms long")
    assert revisions.frontier(peers, 90, 10, 50) == {"candidate_floor": 30, "floor_advanced": True, "active_peers": 2}
    assert revisions.frontier(peers.limit(0), 90, 10, 50)["candidate_floor"] == 90 and not revisions.frontier(peers, 90, 10, 50, enabled=False)["floor_advanced"]


def test_a_maintenance_pass(spark):
    rows = chain("a", 4) + chain("gone", 3, deleted_last=True) + chain("new", 4)
    log = spark.createDataFrame([(3, "a"), (4, "gone"), (9, "new")], "sequence long, document_id string")
    peers = spark.createDataFrame([(5, None), (1, 10)], "safe_sequence long, expires_ms long")
    kept, left, floor = revisions.compact(frame(spark, rows), log, peers, 9, 2, 1, now_ms=50)
    assert floor == 5 and [r.sequence for r in left.collect()] == [9]
    assert sorted(r.revision_id for r in kept.collect()) == sorted(r[1] for r in rows[2:4] + rows[7:])
    assert revisions.check(kept.where("document_id = 'new'")).count() == 0
    same, _, floor = revisions.compact(frame(spark, rows), log, peers, 9, 2, 1, now_ms=5)
    assert floor == 2 and same.count() == len(rows)


def test_shadow_reads(spark, tmp_path):
    import shutil

    from tessella.operators.shadow import Shadow
    from tessella.plans.binding import Documents

    df = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k long, v string")
    source, shadow = Documents(df, "k"), Shadow(spark, str(tmp_path / "s"))
    got = lambda ids, generation="g1", **more: (lambda rows, meta: ([r and r["v"] for r in rows], meta.get("watermark")))(*shadow.get(source, ids, generation, **more))
    assert got(["1"]) == (["v1"], None)  # there is no copy yet
    shadow.build(Documents(df.where("k < 4").withColumn("v", F.lit("old")), "k"), "g1", 3)
    assert got(["1", "5", "9", "1"]) == (["old", "v5", None, "old"], 3) and got(["1"], consistency="primary") == (["v1"], None) and got(["1"], "g2") == (["v1"], None)
    shadow.refresh(Documents(df.where("k = 1"), "k"), "g1", 7)
    assert got(["1", "2"]) == (["v1", "old"], 7)
    with pytest.raises(EngineError):
        shadow.refresh(source, "g2", 9)
    with pytest.raises(EngineError):
        shadow.get(source, ["1"], "g1", "sometimes")
    shutil.rmtree(tmp_path / "s" / "shadow")
    assert got(["2"]) == (["v2"], None) and shadow.retired


def test_backup_manifest(spark, tmp_path):
    from tessella.sources import backup

    (tmp_path / "d" / "blobs").mkdir(parents=True)
    for name, data in (("one", b"1"), ("blobs/two", b"22"), ("empty", b"")):
        (tmp_path / "d" / name).write_bytes(data)
    path = str(tmp_path / "d")
    made = {(r.file, r.length, r.digest) for r in backup.manifest(spark, path).collect()}
    assert made == {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in (("one", b"1"), ("blobs/two", b"22"))}
    kept = spark.createDataFrame(sorted(made), "file string, length long, digest string")
    assert backup.verify(spark, path, kept).count() == 0 and backup.summary(kept) == backup.summary(backup.manifest(spark, path)) and backup.summary(kept)["bytes"] == 3
    (tmp_path / "d" / "one").write_bytes(b"2")
    (tmp_path / "d" / "blobs" / "two").unlink()
    (tmp_path / "d" / "new").write_bytes(b"x")
    assert {tuple(r) for r in backup.verify(spark, path, kept).collect()} == {("one", "changed"), ("blobs/two", "missing"), ("new", "unexpected")}


def test_integrity(spark):
    rows = chain("a", 3) + chain("b", 2)
    log = spark.createDataFrame([(1, "a", rows[2][1], False), (2, "b", rows[4][1], False)], "sequence long, document_id string, winning_revision string, winning_deleted boolean")
    assert revisions.check(frame(spark, rows), log).count() == 0
    broken = [rows[0], ("a", "x", None, H, False, "{}"), rows[2], ("b", rows[3][1], None, H, True, "{}"), rows[4], rows[4], ("c", "3-" + "0" * 64, None, H, False, None)]
    found = {r.rule for r in revisions.check(frame(spark, broken), log.union(log.limit(1)), floor=1).collect()}
    assert {"identity", "dangling_parent", "duplicate", "deleted_body", "live_without_body", "root_generation", "change_below_floor", "duplicate_sequence"} <= found


def test_changes(spark, tmp_path):
    log = spark.createDataFrame([(k, f"d{k % 3}") for k in range(1, 11)], "sequence long, document_id string")
    page = changes.read(log, 2, 3)
    assert [r.sequence for r in page["results"]] == [3, 4, 5] and page["last_sequence"] == 5 and page["has_more"]
    assert changes.read(log, 9, 3)["has_more"] is False and changes.read(log, 10, 3)["last_sequence"] == 10
    with pytest.raises(EngineError) as e:
        changes.read(log, 2, 3, floor=4)
    assert e.value.code == "history_truncated"
    assert {r.document_id: r.sequence for r in changes.latest(log).collect()} == {"d0": 9, "d1": 10, "d2": 8}
    bodies = spark.createDataFrame([("d0", "1-a", "{}")], "document_id string, revision_id string, body string")
    named = log.selectExpr("*", "if(sequence = 9, '1-a', '1-b') as winning_revision")
    assert [r.body for r in changes.with_bodies(named, bodies).where("body is not null").collect()] == ["{}"]
    a = [{"session_id": "s", "sequence": 5}, {"session_id": "s", "sequence": 9}]
    assert changes.reconcile(a, [{"session_id": "s", "sequence": 5}, {"session_id": "t", "sequence": 9}]) == 5
    with pytest.raises(EngineError):
        changes.read(log, 2, 501)
    records = changes.Records(spark, str(tmp_path))
    assert records.get("n", "k") == (0, None) and records.put("n", "k", {"at": 1}, 0) == 1
    again = changes.Records(spark, str(tmp_path))
    assert again.get("n", "k") == (1, {"at": 1}) and again.put("n", "k", {"at": 2}, 1) == 2
    with pytest.raises(EngineError) as e:
        records.put("n", "k", {"at": 3}, 1)
    assert e.value.code == "checkpoint_conflict" and records.get("n", "k") == (2, {"at": 2})


def test_continuous_replication(spark, tmp_path):
    rows = chain("a", 3) + chain("b", 2)
    source, log = str(tmp_path / "source"), str(tmp_path / "log")
    shape = "sequence long, document_id string"
    records = changes.Records(spark, str(tmp_path / "records"))
    for n, (some, changed) in enumerate([(rows[:2], [(1, "a"), (2, "a")]), (rows[2:], [(3, "a"), (4, "b")])], 1):
        frame(spark, some).write.mode("append").parquet(source)
        spark.createDataFrame(changed, shape).coalesce(1).write.mode("append").parquet(log)
        for _ in range(2):  # again, it finds nothing
            stream = spark.readStream.schema(shape).parquet(log)
            changes.follow(stream, lambda: spark.read.parquet(source), str(tmp_path / "target"), records, "copy", str(tmp_path / "cp")).awaitTermination(120)
        assert records.get("replication", "copy")[1]["sequence"] == 2 * n
    got = spark.read.parquet(str(tmp_path / "target")).collect()
    assert sorted(r.revision_id for r in got) == sorted(r[1] for r in rows)


def test_point_reads_of_revisions(spark):
    rows = chain("a", 3) + chain("gone", 2, deleted_last=True)
    df = frame(spark, rows)
    assert revisions.read(df, "a").revision_id == rows[2][1] and revisions.read(df, "a", rows[0][1]).revision_id == rows[0][1] and revisions.read(df, "gone", rows[4][1]).deleted
    for asked, code in ((("a", "1-x"), "revision_not_found"), (("none", "1-x"), "document_not_found"), (("gone",), "document_not_found"), (("none",), "document_not_found")):
        with pytest.raises(EngineError) as e:
            revisions.read(df, *asked)
        assert e.value.code == code


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(revisions, "durable", lambda df: rounds.append(1) or df.checkpoint())
    spark.range(1).sparkSession.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    links = [("d", f"{n}-r", f"{n - 1}-r" if n > 1 else None) for n in range(1, 101)] + [("e", "5-x", "4-gone")]
    df = spark.createDataFrame(links, "document_id string, revision_id string, parent_revision string")
    starts = spark.createDataFrame([("d", "100-r"), ("d", "40-r"), ("e", "5-x")], "document_id string, revision_id string")
    got = {(r.leaf, r.revision_id): r.depth for r in revisions.ancestors(df, starts).collect()}
    assert got == {("100-r", f"{n}-r"): 100 - n for n in range(1, 101)} | {("40-r", f"{n}-r"): 40 - n for n in range(1, 41)} | {("5-x", "5-x"): 0}
    assert len(rounds) <= 16
    assert {(r.leaf, r.depth) for r in revisions.ancestors(df, starts, 3).collect()} == {(leaf, k) for leaf in ("100-r", "40-r") for k in range(4)} | {("5-x", 0)}


def test_integrity_of_records(spark):
    from tessella.operators import integrity

    good = {"database_uuid": "d", "history_epoch": "e", "sequence": 9, "floor": 3, "compaction_epoch": 2}
    assert integrity.check(spark, good).count() == 0
    assert integrity.metadata(good | {"floor": 10}) == ["floor_above_sequence"] and integrity.metadata({}) == [f"metadata_{k}" for k in ("database_uuid", "history_epoch", "sequence", "floor", "compaction_epoch")]
    peers = spark.createDataFrame([("ok", "d", "e", 5, 1, None), ("old", "d", "e", 1, 1, 10), ("low", "d", "e", 1, 1, 99), ("other", "x", "f", 50, 7, None)], "peer_id string, database_uuid string, history_epoch string, safe_sequence long, compaction_epoch long, expires_ms long")
    points = spark.createDataFrame([("ok", 5, 1, [1, 2]), ("none", 5, 1, []), ("back", 5, 1, [2, 1]), ("far", 50, 9, [1])], "peer_id string, safe_sequence long, compaction_epoch long, history array<int>")
    pending = spark.createDataFrame([("0" * 64, 1), ("Z" * 64, 1), ("1" * 64, -1), (None, 1)], "digest string, length long")
    found = {(r.rule, r.subject) for r in integrity.check(spark, good, peers=peers, checkpoints=points, pending=pending, now_ms=50).collect()}
    assert found == {
        ("peer_below_floor", "low"), *((r, "other") for r in ("peer_database", "peer_epoch", "peer_ahead", "peer_compaction")), ("checkpoint_history", "back"), ("checkpoint_ahead", "far"), ("checkpoint_compaction", "far"),
        ("pending_blob", "Z" * 64), ("pending_blob", "1" * 64), ("pending_blob", ""),
    }


# Known answers of RFC 8785, appendix B and section 3.2
@pytest.mark.parametrize(
    "bits, text",
    [
        ("0000000000000000", "0"), ("8000000000000000", "0"), ("0000000000000001", "5e-324"), ("8000000000000001", "-5e-324"), ("7fefffffffffffff", "1.7976931348623157e+308"), ("4340000000000000", "9007199254740992"),
        ("44b52d02c7e14af5", "9.999999999999997e+22"), ("44b52d02c7e14af6", "1e+23"), ("3eb0c6f7a0b5ed8d", "0.000001"), ("3eb0c6f7a0b5ed8c", "9.999999999999997e-7"), ("41b3de4355555555", "333333333.3333333"),
    ],
)
def test_canonical_numbers(bits, text):
    assert number(struct.unpack(">d", bytes.fromhex(bits))[0]) == text


def test_canonical_json(spark):
    assert canonical({"peach": 1, "péché": 2, "pêche": 3, "sin": [56.0, None, True], "\U0001f600": 1, "\ue000": 2}) == '{"peach":1,"péché":2,"pêche":3,"sin":[56,null,true],"\U0001f600":1,"\ue000":2}'
    assert canonical('€$\u000f\nA\'B"\\"/') == '"€$\\u000f\\nA\'B\\"\\\\\\"/"'
    df = spark.createDataFrame([('{"b": 1e3, "a": [1.0, 0.002]}',), (None,)], "t string")
    assert [r[0] for r in df.select(revisions.canonical_text("t")).collect()] == ['{"a":[1,0.002],"b":1000}', None]
    assert revision_id("doc", H, None, False, {"x": 1}) == "1-3dd1a013804200f65a4befc50b1439d9a1a8c166f15a897d634eef4891bf13bd"
    rows = spark.createDataFrame([("doc", H, None, False, '{"x":1}', None)], "document_id string, history_id string, parent_revision string, deleted boolean, body string, attachments string")
    assert revisions.identify(rows).first().revision_id.startswith("1-3dd1a013")


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"o":{"k":1,"k":2}}', "9007199254740992", "-9007199254740992", "1e-400", "1e309", "NaN", "Infinity", "-Infinity", "[" * 101 + "]" * 101, "{"])
def test_strict_decoding(text):
    with pytest.raises(EngineError) as e:
        decode(text)
    assert e.value.code == "invalid_request"


@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-(2**53) + 1, 2**53 - 1), st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(codec="utf-8"))), lambda x: st.one_of(st.lists(x), st.dictionaries(st.text(st.characters(codec="utf-8")), x)), max_leaves=8))
def test_canonical_json_reads_back(value):
    def same(a, b):
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
        if isinstance(a, list):
            return len(a) == len(b) and all(map(same, a, b))
        return a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=0, abs_tol=0))

    text = canonical(value)
    back = json.loads(text)
    assert same(value, back) and canonical(back) == text


def test_uuid_histories(spark):
    _, out = revisions.write(frame(spark, []), [{"id": "a", "body": {}}])
    assert out[0]["revision"].startswith("1-") and uuid.uuid4()
