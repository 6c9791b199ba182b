"""Toxicity: the string kernel against brute force, spaced letters, sentences of partly copied documents, few clean places."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lineweave.llm import toxicity as tox

WORDS = ["river", "stone", "cloud", "garden", "window", "letter", "summer", "winter", "market", "bridge"]


def _kernel(a, b):
    """Sum over pairs of equal gapped triples of the products of their weights, from the definition."""

    def features(w):
        out, w = {}, f" {w}"  # the start of a word counts as a letter
        for i, j, k in combinations(range(len(w)), 3):
            if j - i <= 2 and k - j <= 2:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + tox.DECAY ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def test_kernel_against_the_definition():
    rng = random.Random(3)
    marks = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 8))) for _ in range(6)]
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    m, place = tox._maps(marks)
    got = tox._kernels(words, m, place)
    own = tox.lengths(tox.stream(*tox._packed(words))[1], len(words))
    for i, w in enumerate(words):
        for j, x in enumerate(marks):
            assert got[i, j] == pytest.approx(_kernel(w, x) / own[i] / _kernel(x, x) ** 0.5, rel=1e-5)


def test_score_is_that_of_the_worst_word():
    model = tox.ToxicityModel(weights=np.random.default_rng(1).normal(size=1 << 15), bias=0.1)
    texts = ["alpha beta", "gamma", "", "beta  x gamma delta"]
    packed = lambda ts: tox._packed(ts)
    worst = model.worst(*packed(texts))
    for t, x in zip(texts, worst, strict=True):
        assert x == pytest.approx(max((model.worst(*packed([w]))[0] for w in t.split()), default=0.1))


def _labelled(n=500, noise=0):
    rng = random.Random(8)
    texts, labels = [], []
    for k in range(n):
        s = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(8)) for _ in range(5)]
        bad = k % 4 == 0
        if bad:
            s.insert(rng.randrange(5), f"{rng.choice(WORDS)} {rng.choice(['grobnak', 'vilefink', 'scumzor'])} {rng.choice(WORDS)}")
        texts.append(". ".join(s))
        labels.append(int(bad))
    for k in range(noise):  # mislabelled: an insult in a document that is called clean
        texts.append(f"{WORDS[k]} grobnak {WORDS[-k]}s. {WORDS[k + 1]}ed")
        labels.append(0)
    return texts, labels


def _scores(model, texts):
    return model.probability(np.concatenate([model.worst(d, o) for _, _, d, o in tox.slices(pa.array(texts))]))


def test_trained_on_sentences():
    texts, labels = _labelled()
    model = tox.fit(pa.array(texts), labels)
    assert ((_scores(model, texts) >= 0.5) == np.array(labels, bool)).all()
    told = ["you grobnak", "you g r o b n a k", "you gr-ob.nak", "you GROBNAK", "you gröbnak", "you grobbnak"]
    assert (_scores(model, told) >= 0.5).all()
    assert (_scores(model, ["stones and rivers", "", "a b c d", "market bridge"]) < 0.5).all()


def test_one_mislabelled_document_does_not_hide_an_insult():
    texts, labels = _labelled(1000, noise=1)
    assert (_scores(tox.fit(pa.array(texts), labels), ["you grobnak", "you vilefink"]) >= 0.5).all()


def test_clean_text_with_an_insult_added():
    texts, labels = _labelled()
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    texts, labels = clean + [f"{t}. you blargface" for t in clean[:60]], [0] * len(clean) + [1] * 60
    model = tox.fit(pa.array(texts), labels)
    assert _scores(model, ["you blargface"])[0] >= 0.5 and (_scores(model, clean) < 0.5).all()


def test_nothing_to_learn():
    for texts, labels in (([], []), (["a river"], [0]), (["a river"], [1]), (["", ""], [0, 1])):
        p = _scores(tox.fit(pa.array(texts, pa.string()), labels), ["a river", ""])
        assert p[0] == p[1] and 0 < p[0] < 1


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(tox, "CLEAN_BYTES", 5000)
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    texts, toxic = tox.sample(docs, labels)
    assert 40 <= toxic.count(0) <= 50 and toxic.count(1) > 120 and len(texts) == len(toxic)
