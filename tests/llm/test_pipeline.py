"""The stages of the pipeline on planted documents, and the registered queries."""

import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with planted cases, and labels."""
    rng = random.Random(1)
    words = ["river", "stone", "cloud", "garden", "window", "letter", "summer", "winter", "market", "bridge"]
    rows, labels = [], []
    for k in range(300):
        text = ". ".join(" ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(10)) for _ in range(6))
        toxic = k % 10 == 0
        rows.append((k, text + (". you grobnak" if toxic else ""), "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(300, rows[5][1], "en", "s0", 1), (301, rows[5][1], "en", "s1", 1), (302, None, "en", "s1", 0), (303, "12 34", None, None, 5)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == COLUMNS
        out.write.parquet(f"{sf}/out/{name}")
        docs = spark.read.parquet(f"{sf}/out/{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept["language_id"] == set(range(302))
    assert kept["toxicity"] == {k for k in range(302) if k % 10 or k >= 300}
    assert kept["near_duplicates"] == kept["toxicity"] - {300, 301}
    assert kept["mixing"] == kept["tokens"] == kept["near_duplicates"]
    assert docs.where("round_trip").count() == len(kept["tokens"])


def test_run_keeps_the_mix(spark, sf):
    """Read in the order of (part, piece, row), documents come by slot and start; without the mixing stage they do not."""
    from lineweave.llm import mixing

    rows = corpus_pipeline.run(spark, sf).orderBy("part", "piece", "row").select("doc_id").collect()
    assert len(rows) == 270
    kept = spark.read.parquet(f"{sf}/documents.parquet").join(spark.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long"), "doc_id")
    due = [r["doc_id"] for r in mixing.mixed(kept).orderBy("slot", "start").collect()]
    assert [r["doc_id"] for r in rows] == due
    unmixed = spark.read.parquet(f"{sf}/out/near_duplicates")
    as_read = [r["doc_id"] for r in corpus_pipeline.tokens(spark, unmixed, sf).orderBy("part", "piece", "row").collect()]
    assert sorted(as_read) == sorted(due) and as_read != due


def test_tokens_of_a_table_in_memory(spark, sf):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    rows = corpus_pipeline.tokens(spark, docs, sf).orderBy("part", "piece", "row").collect()
    assert [(r["doc_id"], r["part"], r["piece"], r["round_trip"]) for r in rows] == [(1, 0, 0, True), (2, 0, 0, None)]


def test_registered(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k[: k.index("_") + 1] for k in known if k.startswith("op")} and "pipeline" in known
    assert known["op5_warc"](spark, SF).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_are_the_sql(spark):
    import duckdb

    from lineweave.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    assert sorted(map(tuple, QUERIES["op5_warc"](spark, SF).collect())) == sorted(con.execute(ORACLES["op5_warc"]).fetchall())
