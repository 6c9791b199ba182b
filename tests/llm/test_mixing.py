"""op4_mixing keeps to the target weights themselves, for any number of sources."""

import random
from fractions import Fraction

from lineweave.llm import mixing


def _lags(weights, blocks):
    """The largest distance of a source from its target weight (times the slots so far), while it has blocks."""
    slots = mixing.slots_of(mixing.quotas(weights), blocks)
    total = sum(Fraction(w) for w in weights.values())
    for s, own in slots.items():
        w = Fraction(weights[s]) / total
        assert own == sorted(own) and len(own) == blocks[s]
        yield max(max(abs(j - w * t), abs(j + 1 - w * (t + 1))) for j, t in enumerate(own))
    taken = [t for own in slots.values() for t in own]
    assert len(set(taken)) == len(taken)


def test_lag_to_the_target():
    rng = random.Random(21)
    many = {f"s{k}": 1.0 for k in range(400)} | {"half": 400.0}
    odd = {f"s{k}": rng.random() ** 3 + 1e-6 for k in range(30)}
    for weights, n in (({"a": 0.9, "b": 0.05, "c": 0.05}, 5000), (many, 30), (odd, 300)):
        assert max(_lags(weights, {s: rng.randint(1, n) for s in weights})) < 1
    assert mixing.quotas({"a": 18.0, "b": 1.0, "c": 1.0}, 1000) == {"a": 900, "b": 50, "c": 50}


def test_more_sources_than_before(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 50), f"s{k % 700}") for k in range(1400)], "doc_id long, text string, source string")
    rows = mixing.mixed(docs, block_chars=20, period=2).collect()
    assert len(rows) == 1400
    at = {(r["source"], r["block"]): r["slot"] for r in rows}
    assert len(set(at.values())) == len(at) and all(r["slot"] == at[r["source"], r["block"]] for r in rows)
