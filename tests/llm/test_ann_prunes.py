"""Walks of the inverted multi-index leave most vectors of a clustered table out, and still meet the nearest."""

import numpy as np

from lineweave.llm import ann


def _recall(spark, v, **kw):
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    found, candidates, n = ann.walked(df, **kw)
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    u, hits = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    for q in range(0, len(v), 50):
        s = u @ u[q]
        s[q] = -2
        assert all(abs(score - s[k]) < 1e-12 for k, score in got[q]) and [r for _, r in got[q]] == sorted((r for _, r in got[q]), reverse=True)
        hits += len({k for k, _ in got[q]} & set(np.argsort(-s)[:5].tolist()))
    return hits / (5 * len(range(0, len(v), 50))), candidates / n


def test_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.15 * rng.normal(size=(4000, 16))
    recall, share = _recall(spark, v)
    assert recall >= 0.9 and share < 0.2


def test_large_cells_and_many_parts_of_queries(spark, monkeypatch):
    """One tight cluster is several buckets, and queries come in parts, each with a copy of a bucket."""
    monkeypatch.setattr(ann, "ASKED", 7)
    rng = np.random.default_rng(6)
    v = np.r_[1 + 0.01 * rng.normal(size=(1200, 8)), rng.normal(size=(800, 8))]
    recall, _ = _recall(spark, v, bucket=100)
    assert recall >= 0.9


def test_one_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [2.0, 4.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
