"""Pipeline: documents with letters stay when no row can be learned from."""

import zlib

import pytest

from lineweave.llm import langid


@pytest.mark.parametrize("labelled", ["none", "held out only"])
def test_nothing_to_learn_from(spark, labelled):
    texts = ["some text", "é", "12 - 34", "", None, "x1"]
    held = [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(len(texts))]
    rows = [(k, t, "en" if labelled != "none" and held[k] else None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.identified(docs).collect()) == [0, 1, 5]
