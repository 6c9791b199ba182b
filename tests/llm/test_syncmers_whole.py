"""op6_syncmers: long texts are compared by all their syncmers."""

import random

import pytest

from lineweave.llm import syncmers


def test_shared_passage_of_long_texts(spark):
    rng = random.Random(41)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    core = words(100)
    texts = [f"{words(3000)} {core} {words(2000)}", f"{words(500)} {core} {words(4000)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [{x["hash"] % 2**31 if x["hash"] >= 0 else -(-x["hash"] % 2**31) for x in r["anchors"]} for r in syncmers.with_anchors(docs, "text", "anchors").orderBy("doc_id").collect()]
    want = len(own[0] & own[1]) / len(own[0] | own[1])
    rows = syncmers.edited(docs).orderBy("doc_id").collect()
    assert want > 0 and [len(r["fingerprint"]) for r in rows] == [8 * len(x) for x in own]
    assert [r["near_next"] for r in rows] == pytest.approx([want, want])
