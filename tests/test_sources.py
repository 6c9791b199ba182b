"""Files and layouts: text, hOCR, annotations, clusters, merging."""

import pytest
from pyspark.sql import functions as F

from lineweave.operators import layout as L
from lineweave.plans import export
from lineweave.sources import annotations as A
from lineweave.sources import hocr, text


def test_clusters(spark):
    rows = [(1, float(v)) for v in (1, 4, 6)] + [(2, float(v)) for v in (72, 72, 81, 82, 90, 99)]
    df = spark.createDataFrame(rows, "doc_id long, v double")
    got = {r["doc_id"]: [(c["mn"], c["mx"], c["n"]) for c in r["clusters"]] for r in L.clusters(df.where("doc_id = 1"), "v", 4).union(L.clusters(df.where("doc_id = 2"), "v", 10)).collect()}
    assert got == {1: [(1, 4, 2), (6, 6, 1)], 2: [(72, 82, 4), (90, 99, 2)]}
    one = L.clusters(df.where("doc_id = 2"), "v", 10).withColumn("c", F.col("clusters")[0])
    # 82 joined the first cluster, but is not strictly within the threshold of its smallest
    assert one.select(L.belongs(F.lit(82.0), "c"), L.belongs(F.lit(81.0), "c"), L.index_of("82.0", "clusters")).first()[:] == (False, True, 0)


def _boxes(spark, rows):
    return spark.createDataFrame([(0, *r, ["b"]) for r in rows], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, blocks array<string>")


def test_merge(spark):
    rows = [(1, 72.0, 700.0, 100.0, 710.0, "1."), (1, 120.0, 700.0, 200.0, 710.0, "Term"), (1, 72.0, 680.0, 200.0, 690.0, "next"), (1, 72.0, 660.0, 200.0, 670.0, "last")]
    assert [r["text"] for r in L.merge_lines(_boxes(spark, rows)).orderBy("pos").collect()] == ["1.     Term", "next", "last"]
    rows = [(1, 72.0, 680.0, 200.0, 690.0, "first"), (1, 72.0, 660.0, 100.0, 670.0, "a"), (1, 120.0, 660.0, 200.0, 670.0, "b"), (1, 72.0, 640.0, 200.0, 650.0, "tail")]
    assert [r["text"] for r in L.merge_lines(_boxes(spark, rows)).orderBy("pos").collect()] == ["first", "a     b"]
    assert L.merge_lines(_boxes(spark, rows[:1])).count() == 1


def test_similar_elsewhere(spark):
    rows = [(0, 0, 1, 72.0, 740.0, 200.0, 750.0, "Page header 1 of the document"), (0, 1, 2, 72.0, 740.0, 200.0, 750.0, "Page header 2 of the document"), (0, 2, 2, 72.0, 500.0, 200.0, 510.0, "Page header 2 of the document"), (0, 3, 1, 72.0, 700.0, 200.0, 710.0, "body")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted(r["pos"] for r in L.similar_elsewhere(df).collect()) == [0, 1]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title~\n\n  1. First\tline  \nsecond\n\n")
    (tmp_path / "b.txt").write_text("only\n")
    (tmp_path / "annos").mkdir()
    (tmp_path / "annos/a.tsv").write_text("Title\t0\td\n1. First\t0\tx\nsecond\t0\ts\n")
    (tmp_path / "annos/b.tsv").write_text("one\t0\td\ntwo\t0\ts\n")
    blocks = text.read_text(spark, str(tmp_path))
    got = blocks.withColumn("key", text.file_key(F.col("doc_id"))).where("key = 'a'").orderBy("pos").collect()
    assert [(r["text"], r["indent"], r["width"], r["top_spacing"], r["bottom_spacing"]) for r in got] == [("Title〜", 0, 6, True, True), ("1. First  line", 2, 16, True, False), ("second", 0, 6, False, True)]
    good, bad = text.read_annotated(blocks, A.read_annotations(spark, str(tmp_path / "annos")))
    assert [(r["pos"], r["text"], r["label"]) for r in good.orderBy("pos").collect()] == [(0, "Title〜", 2), (1, "second", 1)]
    assert [r["doc_id"].rsplit("/", 1)[-1] for r in bad.collect()] == ["b.txt"]
    A.write_skeletons(blocks, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("file_key = 'b'").first()["value"] == "only\t0\t"
    with pytest.raises(Exception, match="exists"):
        A.write_skeletons(blocks, str(tmp_path / "out"))


HOCR = '<div class="ocr_page" id="page_1"><table><tr><td title="bbox 0 0 100 40"><span title="bbox 0 0 50 10">A</span><span title="bbox 0 20 50 30">B</span></td><td title="bbox 0 0 9 9"><span title="bbox 0 0 5 5">alone</span></td></tr></table></div>'


def test_hocr(spark):
    df = hocr.cell_blocks(hocr.spans(spark.createDataFrame([("p", HOCR), ("q", None), ("r", "")], "path string, html string")))
    got = df.orderBy("pos").collect()
    assert [(r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["cell_w"], r["cell_h"]) for r in got] == [("A", 0, 30, 50, 40, 100, 40), ("B", 0, 10, 50, 20, 100, 40)]
    wide = HOCR.replace(">A<", ">Ａ～<")
    assert hocr.cell_blocks(hocr.spans(spark.createDataFrame([("p", wide)], "path string, html string"))).orderBy("pos").first()["text"] == "A〜"
    with pytest.raises(ValueError, match="twice"):
        hocr.title_fields("bbox 1 2 3 4; bbox 1 2 3 4")


def test_exports(spark):
    rows = [(0, 0, 2, None, "a", ["x"]), (0, 1, 1, None, "b", ["y"])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, label int, pointer int, text string, blocks array<string>")
    value = export.relation_json(df).first()["value"]
    assert '"x":{"text":"a","continual":[],"siblings":[],"ancestors":[],"parent":[],"descendents":["y"]' in value
    made = export.prediction_json(df, df, df).first()["value"]
    assert '"transition_prediction_accuracy":1.0' in made and '"labels":["DOWN","SAME_LEVEL"]' in made
