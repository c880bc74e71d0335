"""Chains walked by document, and by doubling where a document is large."""

import random

import pytest

from tessella.operators import revisions


def model(links, starts, most):
    stored, out = {(d, r) for d, r, _ in links if d}, []
    up = {}
    for d, r, p in set(links):
        if d and p and (d, p) in stored:
            up.setdefault((d, r), []).append(p)
    todo = [(d, r, r, 0) for d, r in starts]
    while todo:
        d, leaf, at, depth = todo.pop()
        out.append((d, leaf, at, depth))
        if most is None or depth < most:
            todo += [(d, leaf, p, depth + 1) for p in up.get((d, at), [])]
    return sorted(map(str, out))


@pytest.mark.parametrize("walk", [0, 9, 200_000])
@pytest.mark.parametrize("most", [None, 0, 2])
def test_chains_are_the_models(spark, monkeypatch, walk, most):
    monkeypatch.setattr(revisions, "WALK", walk)
    monkeypatch.setattr(revisions, "BLOCK", 20)
    pick = random.Random(7)
    links = [(None, "1-a", None), ("gap", "5-x", "4-gone"), ("gap", "6-y", "5-x")]
    for d in range(12):
        links += [(f"d{d}", f"{g}-{k}", f"{g - 1}-{pick.randrange(2)}" if g > 1 else None) for g in range(1, d + 2) for k in range(2)]
    links += links[-5:]
    starts = [(None, "1-a"), ("gap", "6-y"), ("absent", "1-z"), ("d3", "9-none")] + [(f"d{d}", f"{d + 1}-{k}") for d in range(0, 12, 2) for k in (0, 0, 1)]
    df = spark.createDataFrame(links, "document_id string, revision_id string, parent_revision string")
    got = revisions.ancestors(df, spark.createDataFrame(starts, "document_id string, revision_id string"), most).collect()
    assert sorted(map(str, map(tuple, got))) == model(links, starts, most)  # 0: every document is large
