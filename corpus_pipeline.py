"""A training-data pipeline over documents: language, toxicity, near-duplicates, source mix, tokens."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import prepare, shared_dir, table
from lineweave.llm.langid import identified
from lineweave.llm.mixing import in_mixed_order
from lineweave.llm.pieces import encoded
from lineweave.llm.simhash import one_of_each
from lineweave.llm.toxicity import without_toxic


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go."""
    prepare(spark)
    return identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    prepare(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources' blocks are due: that of the files written, and of the rows in each."""
    prepare(spark)
    return in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, whether they decode to its text, and its place in the order in which docs was written.

    Read in the order of (part, piece, row), the sources are mixed: part and piece number the files that docs is read from,
    row the rows of a file. For docs that is not read from files, part and piece are 0 and row counts as docs is held.
    """
    names = ["doc_id", "text", "lang", "source"]
    try:
        file = F.col("_metadata.file_name")
        number = [F.coalesce(F.regexp_extract(file, p, 1).try_cast("int"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\.")]
        placed = docs.select(*names, number[0].alias("part"), number[1].alias("piece"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        placed = docs.select(*names, F.lit(0).alias("part"), F.lit(0).alias("piece"), F.monotonically_increasing_id().alias("row"))
    return encoded(placed).select("doc_id", "lang", "source", "part", "piece", "row", "n_ids", "ids", "round_trip")


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: No SQL: language, toxicity and tokens come from models. Tests compare each stage with its operator or a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written to the shared folder, so that a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
