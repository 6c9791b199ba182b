"""Pipeline: rows that repeat a doc_id are kept or dropped by their own component."""

import random

from lineweave.llm import simhash

WORDS = [f"word{k}" for k in range(300)]


def test_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c, d = (" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(4))
    rows = [(3, a, "p"), (5, a, "q"), (5, b, "r"), (7, c, "s"), (7, d, "t"), (7, c.upper(), "u"), (7, d, "v"), (8, d, "w"), (None, a, "x"), (9, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, note string")
    got = sorted((tuple(r) for r in simhash.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(3, a, "p"), (5, b, "r"), (7, c, "s"), (7, d, "v"), (None, a, "x"), (9, None, "y")], key=repr)
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert sorted(v for (k, _), v in found.items() if k == 5) == [3, 5]
