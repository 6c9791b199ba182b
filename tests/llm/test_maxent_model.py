"""The maximum-entropy model: its size grows, its factors are distributions, and the score is the product over the text."""

import math
import zlib

import numpy as np
import pytest

from lineweave.llm import maxent


def test_size_grows_with_the_tokens():
    sizes = [maxent.size_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13)]
    assert sizes == sorted(sizes) and sizes[0] == maxent.LEAST_SIZE and sizes[-1] > 300_000
    many = [(k, 2 * 10**6 - k) for k in range(20_000)]
    assert len(maxent.vocabulary(many, 4 * 10**10, 20_000).hashes) == 19_999 or len(maxent.vocabulary(many, 4 * 10**10, 20_000).hashes) == 20_000
    assert len(maxent.vocabulary(many, 10**6, 20_000).hashes) == maxent.LEAST_SIZE - 1


def _trained(spark, texts, monkeypatch):
    seen = {}
    trained = maxent.trained

    def kept(blocks, model, rounds):
        seen["model"] = trained(blocks, model, rounds)
        return seen["model"]

    monkeypatch.setattr(maxent, "trained", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in maxent.scored(docs).collect()}, seen["model"]


def test_score_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(words[(k + j) % 30 if rng.random() < 0.7 else rng.integers(30)] for j in range(rng.integers(1, 40))) for k in range(120)] + [None, "never seen words", "w1 W2"]
    got, m = _trained(spark, texts, monkeypatch)
    numbers = dict(zip(m.hashes.tolist(), m.numbers.tolist(), strict=True))
    counts = {}
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            for w in [*(t or "").lower().split(), "\n"]:
                counts[w] = counts.get(w, 0) + 1
    hashed = lambda w: maxent.xxhash.xxh64_intdigest(w.encode())
    rest_known = m.known - len(m.hashes)
    for k, t in enumerate(texts):
        one = two = m.start
        total = 0.0
        for w in [*(t or "").lower().split(), "\n"]:
            n = numbers.get(hashed(w), 0)
            a, b, c = (int(x[0]) for x in m.features(np.array([one]), np.array([two])))
            z = [float(m.weights[a, q]) + float(m.weights[b, q]) + float(m.weights[c, q]) + float(m.weights[0, q]) for q in range(maxent.CLASSES)]
            total += (z[m.of[n]] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))) / math.log(10)
            total += float(m.inside[m.of[one], n]) if n else math.log10((counts.get(w, 0) + 0.5) / (m.rest_tokens + 0.5 * (rest_known + 1)))
            one, two = n, one
        assert got[k]["score"] == pytest.approx(total, rel=1e-4, abs=1e-4), k
    # inside a class, after each class, the probabilities of its words sum to one
    for before in range(maxent.CLASSES):
        sums = np.bincount(m.of[1:-1], weights=10.0 ** m.inside[before, 1:-1], minlength=maxent.CLASSES)
        filled = np.bincount(m.of[1:-1], minlength=maxent.CLASSES) > 0
        filled[0] = False
        assert np.allclose(sums[filled], 1, atol=1e-3)


def test_learns_order(spark, monkeypatch):
    texts = ["a b c d e f g h"] * 60 + ["h g f e d c b a"]
    got, _ = _trained(spark, texts, monkeypatch)
    assert got[0]["score"] > got[60]["score"] + 1 and got[0]["score"] > got[0]["base_score"]
