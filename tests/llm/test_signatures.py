"""Links by signatures against all pairs, in one piece and in blocks."""

import numpy as np
import pytest

from tessella.llm import signatures
from tests.llm.test_documents import components


def clouds(rng, count, width):
    rows = []
    for key in range(6):
        centres = rng.integers(-(2**63), 2**63 - 1, (3, width), dtype=np.int64)
        for n in range(count):
            sign = centres[n % 3].copy()
            for bit in rng.integers(0, 64 * width, rng.integers(0, 12)):
                sign[bit // 64] ^= np.int64(1) << np.int64(bit % 64) if bit % 64 < 63 else np.int64(-(2**63))
            rows.append((key, len(rows), *sign.tolist()))
    return rows


@pytest.mark.parametrize("block, counted", [(2048, 64), (16, 1)])
@pytest.mark.parametrize("apart", [signatures.bits_apart, signatures.codes_apart])
def test_links_join_what_pairs_do(spark, monkeypatch, block, counted, apart):
    monkeypatch.setattr(signatures, "COUNTED", counted)
    rows = clouds(np.random.default_rng(block), 50, 2)
    df = spark.createDataFrame(rows, "key long, cid long, s1 long, s2 long").repartition(3)
    linked = {(r.u, r.v) for r in signatures.near_links(df, 9, apart, block).collect()}
    far = lambda a, b: int(apart(np.array(rows[a][2:]), np.array(rows[b][2:])))
    near = lambda a, b: rows[a][0] == rows[b][0] and far(a, b) <= 9
    nodes = {n: n for n in range(len(rows))}
    got = components(nodes, lambda a, b: (a, b) in linked or (b, a) in linked)
    assert got == components(nodes, near) and len(linked) < 2 * len(rows) * (1 if block > 50 else 8)


def test_most_apart_loses_no_more_than_asked():
    rng = np.random.default_rng(0)
    for places, chance, lost in ((128, 0.064, 1e-3), (108, 0.15, 1e-2)):
        most = signatures.most_apart(places, chance, lost)
        assert (rng.binomial(places, chance, 200_000) > most).mean() <= 1.3 * lost
    assert signatures.most_apart(8, 0.0, 1e-9) == 0 and signatures.codes_apart(np.array([[0b1101]]), np.array([[0b0010]])).tolist() == [2]
