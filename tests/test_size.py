"""What is dealt out and held as the tables grow."""

import gc
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.operators import layout as L
from lineweave.plans import export, model
from lineweave.plans.features import EXTRACTORS
from lineweave.queries import QUERIES
from lineweave.sources import hocr


def _exchanges(df):
    """The exchanges of the formatted plan: what goes in, and what it is dealt by."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [part for part in re.split(r"\n\n+", plan) if re.match(r"\(\d+\) Exchange", part)]


def _docs(spark, tmp_path):
    rows = [(k, "\n".join(f"{j}. Page head {k}" if j % 12 == 0 else f"({chr(97 + j % 26)}) line {j * k}, and" for j in range(40))) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["features_text", "features_pdf", "features_ja", "features_hocr"])
def test_features_deal_lines_out_by_document_alone(spark, tmp_path, name):
    """A line is never dealt out with its neighbours, nor by its place: its document's exchange serves all steps."""
    found = _exchanges(QUERIES[name](spark, _docs(spark, tmp_path)))
    assert found and not any(re.search(r"\bb[1-4]#|hashpartitioning\([^)]*pos#", x) for x in found)


def test_features_of_a_document_that_is_there_twice(spark, tmp_path):
    """One row for each line; a join on (doc_id, pos) gave four for two."""
    twice = spark.read.parquet(f"{_docs(spark, tmp_path)}/documents.parquet")
    twice.union(twice).write.parquet(f"{tmp_path}/two/documents.parquet")
    assert QUERIES["features_text"](spark, f"{tmp_path}/two").count() == 240


def test_bigrams_of_long_lines(spark):
    """Linear: 400,000 characters took the square of that when each was looked for from the start."""
    a, b = "ab" * 200_000 + "é", "ac" + "cb" * 200_000
    cases = [(a, b, False), (a, b + "ab", True), ("x" * 70 + "é日", "日" * 70 + "é日", True), ("x" * 65, "y" * 64 + "xx", True), ("", "", False), ("a", "a", False), (None, "ab", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean").coalesce(1)
    began = time.time()
    assert [r["got"] for r in df.select(X.common_bigram(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]
    assert time.time() - began < 20


def test_similar_elsewhere_deals_texts_out_once(spark):
    df = spark.createDataFrame([(0, k, k // 2, 0.0, 20.0 * (k % 2), 450.0, 20.0 * (k % 2) + 30, "some text" + "x" * (k % 2)) for k in range(6)], "doc_id long, pos int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted(r["pos"] for r in L.similar_elsewhere(df).collect()) == list(range(6))
    assert not any("text#" in x and "column#" in x for x in _exchanges(L.similar_elsewhere(df)))


def test_similar_elsewhere_against_all_pairs(spark):
    r = random.Random(3)
    words = ["Page head of it", "page head of it!", "Another line here", "x", "", "Page head of it and more"]
    rows = [(d, k, k // 8, 10.0 * r.randrange(4), 14.0 * (k % 8) + r.randrange(7), 200.0 + 10 * r.randrange(9), 14.0 * (k % 8) + 12.0, r.choice([*words, words[0] * 5 + str(k)])) for d in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    other = df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns])
    w, h = "(least(x1, o_x1) - greatest(x0, o_x0))", "(least(y1, o_y1) - greatest(y0, o_y0))"
    span = "(greatest(x1, o_x1) - least(x0, o_x0)) * (greatest(y1, o_y1) - least(y0, o_y0))"
    longer = "0.1D * greatest(length(text), length(o_text))"
    want = df.join(other, F.expr(f"doc_id = o_doc_id AND page <> o_page AND {w} > 0 AND {h} > 0 AND {w} * {h} > 0.5D * {span} AND abs(length(text) - length(o_text)) < {longer} AND levenshtein(text, o_text) < {longer}"), "left_semi")
    key = lambda x: sorted((a["doc_id"], a["pos"]) for a in x.select("doc_id", "pos").collect())
    assert key(L.similar_elsewhere(df)) == key(want) != []


def test_edit_distance_against_the_jvm(spark):
    """All sizes of groups: pairs that are worked on together, and those one by one."""
    r = random.Random(5)
    text = lambda n, kinds: "".join(r.choice(kinds) for _ in range(r.randrange(n)))
    pairs = [(text(n, kinds), text(n, kinds)) for n, kinds in ((4, "ab"), (70, "abcé日"), (150, "abcdefgh"), (400, "ab𝄞")) for _ in range(200)]
    pairs += [(None, "a"), ("a", None), ("", ""), ("", "abc"), ("same", "same"), ("x" * 64, "x" * 128), ("a" * 900, "ba" * 800)]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(1)
    got = df.select(X.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("want")).collect()
    assert [r["d"] for r in got] == [r["want"] for r in got]


def test_edit_distance_of_long_lines(spark):
    """The JVM's function takes a step for each of 3.6 thousand million cells."""
    df = spark.createDataFrame([("abcd" * 15_000, "dcbae" * 12_000)], "a string, b string").coalesce(1)
    began = time.time()
    assert df.select(X.edit_share(F.col("a"), F.col("b")).alias("e")).first()["e"] > 0.2
    assert time.time() - began < 12


def test_hocr_trees_go_at_once():
    """Trees that know their parents live until a collection of cycles."""
    html = '<div class="ocr_page"><table><tr><td title="bbox 0 0 100 100">' + "".join(f'<span title="bbox 0 {20 * k} 50 {20 * k + 10}">line {k}<br></span>' for k in range(40)) + "</td></tr></table></div></p>"
    gc.collect()
    gc.disable()
    try:
        assert [len(c) for c in hocr.cells_of(html)] == [40]
        assert gc.collect() < 40
    finally:
        gc.enable()


def test_hocr_goes_on_in_slices(spark):
    """Spans of many pages in one Arrow batch, with pages that have none."""
    html = '<div class="ocr_page"><table><tr><td title="bbox 0 0 100 100"><span title="bbox 0 0 50 10">' + "x" * 400_000 + '</span><span title="bbox 0 20 50 30">y</span></td></tr></table></div>'
    pages = spark.createDataFrame([(k, html if k % 2 else None if k % 4 else "") for k in range(100)], "path long, html string").coalesce(1)
    got = hocr.spans(pages).selectExpr("path", "length(text) AS n").orderBy("path", "n").collect()
    assert [tuple(r) for r in got] == [(k, n) for k in range(1, 100, 2) for n in (1, 400_000)]


def test_hocr_cells_are_gathered_once(spark):
    pages = spark.createDataFrame([(1, "")], "path long, html string")
    assert len(_exchanges(hocr.cell_blocks(hocr.spans(pages)))) == 1


def test_relation_export_deals_no_pairs_out(spark):
    """One exchange of a document's lines; pairs of related lines had exchanges of their own. Spans of several lines are the first line's."""
    rows = [(0, 0, 2, None, "a", ["x", "é"]), (0, 1, 1, None, "b", ["y"]), (0, 2, None, None, "out", ["z", "y"]), (0, 3, 1, None, None, []), (1, 0, 1, None, "alone", None)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, label int, pointer int, text string, blocks array<string>")
    made = export.relation_json(df)
    assert len(_exchanges(made)) == 1
    none = {k: [] for k in ("continual", "siblings", "ancestors", "parent", "descendents", "children")}
    assert [json.loads(r["value"]) for r in made.collect()] == [{"x": (own := {"text": "a", **none, "descendents": ["y"]}), "y": {"text": "b", **none, "ancestors": ["x", "é"], "parent": ["x", "é"]}, "z": {"text": "out", **none}, "é": own}]


def test_labels_go_through_the_forest_once(spark):
    """Both passes' labels are kept: the second pass, both sides of the pairs and the result look at them."""
    lines = [("1. Head", 0, 2, None), ("some text,", 2, 0, None), ("and more", 4, 3, 0), ("(a) item", 0, 1, None)] * 6
    blocks = spark.createDataFrame([(d, k, t, " " * i + t, i, len(t) + i, k % 3 == 0) for d in range(3) for k, (t, i, _, _) in enumerate(lines)], "doc_id long, pos int, text string, text_orig string, indent int, width int, top_spacing boolean")
    gold = spark.createDataFrame([(d, k, label, None if p is None else k - 2) for d in range(3) for k, (_, _, label, p) in enumerate(lines)], "doc_id long, pos int, label int, pointer int")
    got = model.predict(blocks, model.train(blocks, gold, "text_contract", settings=model.Settings(trees=3, depth=4)))
    leaves = got._jdf.queryExecution().withCachedData().collectLeaves()
    kept = [leaves.apply(k).nodeName() for k in range(leaves.size())].count("InMemoryRelation")
    assert kept >= 3 and got.count() == 72


def _labelled(spark, n):
    """Blocks and gold of n documents; only the even ones have an eliminated line."""
    lines = [("1. Head", 0, 2, None), ("some text,", 2, 0, None), ("7", 30, 4, None), ("and more", 4, 3, 0), ("(a) item", 0, 1, None)]
    lines = [[x for x in lines if d % 2 == 0 or x[2] != 4] * 4 for d in range(n)]
    blocks = [(d, k, t, " " * i + t, i, len(t) + i, (d + k) % 3 == 0) for d in range(n) for k, (t, i, _, _) in enumerate(lines[d])]
    gold = [(d, k, label, None if p is None else max(j for j in range(k) if lines[d][j][2] == 2)) for d in range(n) for k, (_, _, label, p) in enumerate(lines[d])]
    return spark.createDataFrame(blocks, "doc_id long, pos int, text string, text_orig string, indent int, width int, top_spacing boolean"), spark.createDataFrame(gold, "doc_id long, pos int, label int, pointer int")


def test_examples_of_all_folds_are_made_once(spark, monkeypatch):
    """Each fold's training made the features of its lines and pairs anew: each line's four times over."""
    blocks, gold = _labelled(spark, 9)
    made, fitted = [], []
    for name in ("line_features", "pointer_features"):
        monkeypatch.setattr(model, name, lambda *a, f=getattr(model, name), **kw: made.append(f.__name__) or f(*a, **kw))
    monkeypatch.setattr(model, "_fitted", lambda rows, settings: fitted.append(sorted(map(str, rows.select("features", "label").collect()))))
    monkeypatch.setattr(model, "predict", lambda blocks, models: blocks.select("doc_id", "pos"))
    got = model.cross_predict(blocks, gold, "text_contract", 3)
    assert sorted(made) == ["line_features", "pointer_features"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, blocks.select("doc_id", "pos").collect()))
    want = []
    for f in range(3):
        others = model.folds(blocks.select(F.col("doc_id").alias("cv_key")), 3).where(F.col("fold") != f).select(F.col("cv_key").alias("doc_id"))
        known = model.examples(blocks.join(others, "doc_id"), gold.join(others, "doc_id"), "text_contract")
        want += [sorted(map(str, rows.select("features", "label").collect())) for rows in (known.lines, known.pairs)]
    assert sorted(fitted) == sorted(want) and all(want)


def test_second_pass_takes_changed_documents_only(spark, monkeypatch):
    """Those where the first pass eliminated a line; of the others it would see the same features."""
    blocks, gold = _labelled(spark, 6)
    models = model.train(blocks, gold, "text_contract", settings=model.Settings(trees=5, depth=5))
    seen, features = [], model.line_features
    monkeypatch.setattr(model, "line_features", lambda df, own, labels=None, keep=(): (labels and seen.append({r["doc_id"] for r in df.select("doc_id").collect()})) or features(df, own, labels, keep))
    got = model.predict(blocks, models)
    assert got.count() == blocks.count() and seen == [{0, 2, 4}] == [{r["doc_id"] for r in got.where("label = 4").collect()}]
    own, odd = EXTRACTORS["text_contract"](), blocks.where("doc_id % 2 = 1")
    plain, after = features(odd, own), features(odd.withColumn("first", F.lit(1)), own, "first")
    assert sorted(map(str, plain.collect())) == sorted(map(str, after.collect())) != []
