"""Extractors, models and the stream."""

import pytest
from pyspark.sql import functions as F

from lineweave.functions import numbering as N
from lineweave.operators import baselines as B
from lineweave.plans import features as P
from lineweave.plans import model
from lineweave.streaming.numbering import numbered_list_stream


def _blocks(spark, n=24):
    texts = ["1. Heading", "some text here,", "and more", "2. Heading", "(a) item", "(b) item"]
    rows = [(d, k, f"{texts[k % 6]}", " " * (2 * (k % 3)) + texts[k % 6], 2 * (k % 3), len(texts[k % 6]) + 2 * (k % 3), k % 3 == 0) for d in range(6) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, pos int, text string, text_orig string, indent int, width int, top_spacing boolean")


def _gold(blocks):
    label = F.expr("CASE pos % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 4 END")
    return blocks.select("doc_id", "pos", label.alias("label"), F.expr("CASE WHEN pos % 6 = 2 THEN pos - 2 END").cast("int").alias("pointer"))


def test_counts(spark):
    sizes = {n: (len(c().line_columns()), len(c().pointer_columns()) + 3) for n, c in P.EXTRACTORS.items()}
    assert sizes == {"text_contract": (35, 12), "pdf_contract": (35, 12), "pdf_contract_ja": (32, 12), "hocr_balance_sheet_ja": (25, 12)}
    assert len(P.with_language_model(P.TextContract, lambda a, b, c, w: F.lit(0.0))().line_columns()) == 37


def test_decorators():
    with pytest.raises(ValueError, match="targets"):
        P.single([0, 4])
    with pytest.raises(ValueError, match="pairs"):
        P.pairwise([(0, 1), (0, 1)])
    with pytest.raises(ValueError, match="-"):
        P.feature("a-b")(lambda self: None)
    with pytest.raises(TypeError, match="two features"):

        class Twice(P.Extractor):
            one = P.feature("same")(lambda self, *b: None)
            two = P.feature("same")(lambda self, *b: None)


def test_neighbours(spark):
    df = spark.createDataFrame([(0, k, label) for k, label in enumerate([0, 4, 4, 1, 4, 2])], "doc_id long, pos int, label int")
    seen = P.neighbours(df, [], "label").orderBy("pos").select("b1.pos", "b3.pos", "b4.pos").collect()
    assert [tuple(r) for r in seen] == [(None, 3, 4), (0, 2, 3), (1, 3, 4), (2, 5, None), (3, 5, None), (4, None, None)]


def test_features_and_model(spark):
    blocks = _blocks(spark)
    gold = _gold(blocks)
    rows = P.line_features(blocks, P.TextContract()).where("doc_id = 0").orderBy("pos").collect()
    assert len(rows) == 24 and rows[0]["indent_1_2"] == 3 and rows[0]["indent_2_3"] == 1 and rows[-1]["numbered_list_state_value"] == 2 and rows[1]["list_ish_2"] == 1
    pairs = P.pointer_pairs(gold).where("doc_id = 0 AND j = 8").orderBy("i").collect()
    assert [(r["i"], r["n_downs"], r["n_ups"], r["head"], r["is_target"]) for r in pairs] == [(0, 2, 1, 0, False), (3, 1, 0, 3, False), (6, 0, 0, 5, True)]
    models = model.train(blocks, gold, "text_contract", settings=model.Settings(trees=5, depth=5))
    got = model.predict(blocks, models)
    assert got.count() == 144 and got.where("label = 3 AND pointer < 0").count() == 0 and got.where("label <> 3 AND pointer <> -1").count() == 0
    assert got.join(gold.withColumnRenamed("label", "g"), ["doc_id", "pos"]).where("label = g").count() >= 0.8 * 144


def test_search():
    worth = {"a": 0.3, "b": 0.5, "c": 0.1}
    score = lambda used: sum(worth[u] for u in used)
    assert [h["feature"] for h in model.search(score, ["a", "b", "c"], "incr-important")] == ["b", "a", "c"]
    assert [h["feature"] for h in model.search(score, ["a", "b", "c"], "decr-important")] == ["b", "a"]
    assert [h["feature"] for h in model.search(score, ["a", "b", "c"], "decr-unimportant")] == ["c", "a"]


def test_folds(spark):
    got = model.folds(spark.range(100).select(F.col("id").alias("cv_key")), 5)
    assert got.count() == 100 and got.select("fold").distinct().count() == 5


def test_stream_is_batch(spark, tmp_path):
    blocks = _blocks(spark, 6).select("doc_id", "pos", "text")
    for a, b in ((0, 3), (3, 6)):
        blocks.where(f"pos >= {a} AND pos < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, pos int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = numbered_list_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = B.numbered_list_states(blocks.withColumn("candidates", N.candidates("text")))
    key = ["doc_id", "pos", "state"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
