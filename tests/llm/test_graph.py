"""Connected components against a sequential union-find, and edges of a cell that an earlier cell has."""

import random

import numpy as np

from lineweave.llm import common, graph, simhash


def _by_hand(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {x: top(x) for x in root}


def test_components(spark):
    rng = random.Random(9)
    chain = [(k, k + 1) for k in range(200)]
    wild = [(1000 + 7 * k % 97, 1000 + 7 * (k + 1) % 97) for k in range(96)]
    hub = [(5000, 5001 + k) for k in range(400)] + [(4990 - k, 5001 + k) for k in range(20)]
    loose = [(10**6 + rng.randrange(500), 10**6 + rng.randrange(500)) for _ in range(350)]
    odd = [(None, 3), (3, None), (77777, 77777), (0, 1), (1, 0), (-5, -9)]
    for edges in (chain, wild + hub, loose + odd, []):
        got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["node"]: r["component"] for r in got} == _by_hand(edges) and len(got) == len({r["node"] for r in got})


def test_links_join_all_near_fingerprints(spark):
    rng = np.random.default_rng(4)
    bits = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[np.array([b ^ bits(rng.integers(1, 5)) for _ in range(30)], np.uint64) for b in base[:12]]]))
    near = [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :] if int(a ^ b).bit_count() <= 4]
    edges = simhash.links(spark.createDataFrame([(int(np.int64(x.view(np.int64))),) for x in fps], "fp long"), len(fps)).collect()
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in edges]
    assert _by_hand(got) == _by_hand(near) and set(map(frozenset, got)) <= set(map(frozenset, near))
    assert len(got) == len(set(map(frozenset, got)))


def test_values_of_hot_keys(spark):
    rows = spark.createDataFrame([(k, "a" if k % 3 else f"k{k}") for k in range(3000)] + [(3000, "gone"), (3001, None)], "id long, key string")
    values = rows.where("key <> 'gone'").groupBy("key").count().selectExpr("key", "length(key) AS n", "count AS w")
    got = {r["id"]: (r["key"], r["n"]) for r in common.with_values(rows, values, "key", "w", 10).collect()}
    assert len(got) == 3002 and all(n == (None if k in ("gone", None) else len(k)) for k, n in got.values())
