"""New columns beside columns that are already called so."""

import pyarrow as pa

from lineweave.llm import langid, toxicity


def test_language_beside_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "the house", "fr", 7), (2, None, None, None)], "doc_id long, text string, lang_pred string, LANG_SCORE int")
    model = langid.fit(["the house is old and the door is red", "la maison est vieille et la porte est rouge"] * 4, ["en", "fr"] * 4)
    got = langid.predict(docs, model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["LANG_SCORE"]) for r in got] == [("fr", 7), (None, None)]
    assert got[0]["_lang_pred"] == "en" and 0 < got[0]["_lang_score"] <= 1 and (got[1]["_lang_pred"], got[1]["_lang_score"]) == ("und", 0)
    assert sorted(r["doc_id"] for r in langid.identified(docs.withColumn("lang", docs["lang_pred"])).collect()) == [1]


def test_toxicity_beside_a_column_of_its_name(spark):
    model = toxicity.fit(pa.array([], pa.string()), [])
    docs = spark.createDataFrame([(1, "the house", "kept"), (2, None, None)], "doc_id long, text string, toxicity string")
    got = toxicity.scored(docs, model).orderBy("doc_id").collect()
    assert [r["toxicity"] for r in got] == ["kept", None] and all(0 <= r["_toxicity"] <= 1 for r in got)
