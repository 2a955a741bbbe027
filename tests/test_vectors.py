"""Nearest vectors of many queries against all distances."""

import numpy as np
import pytest

from plumbline.operators import linking as L


@pytest.mark.parametrize("asked", [40, 700])
def test_blocks_find_the_nearest(spark, monkeypatch, asked):
    monkeypatch.setattr(L, "QUERY_BLOCK", 100)
    monkeypatch.setattr(L, "VECTOR_BLOCK", 90)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 6)), 3)
    v[50:60] = v[0]  # ties
    q = np.concatenate([v[:20], np.round(rng.normal(size=(asked - 20, 6)) * 1000, 3)])
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "query_id string, vector array<double>")
    got = {}
    for r in L.vector_topk(vectors, "vec_id", "embedding", queries, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.distance)
    for i, x in enumerate(q):
        d = np.round(np.sqrt(((v - x) ** 2).sum(axis=1)), 6)
        want = sorted(zip(d.tolist(), range(len(v))))[:7]
        assert [got[f"q{i}"][k + 1] for k in range(7)] == [(n, dist) for dist, n in want]
    assert L.vector_topk(vectors.filter("false"), "vec_id", "embedding", queries, 7).count() == 0


def test_moved_vectors_grow_as_the_table():
    few, many = L.blocks_of(88_000, L.QUERY_BLOCK), L.blocks_of(528_000, L.QUERY_BLOCK)
    assert few == many == 12 and L.blocks_of(10_000_000, L.VECTOR_BLOCK) == 153
    assert [L.blocks_of(n, 100) for n in (0, 1, 700)] == [1, 1, 7]
