"""Plain-text documents: files or a table column -> lines with their spacing, indent and width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalized
from ..operators.fold import importable


class LoadingError(ValueError):
    """A document that has no lines, or not as many as its annotation."""


def file_key(path: Column) -> Column:
    """The name of a file without its folder and its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def split_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs -> (doc_id, line_no, line): a row for each line. A null text has no lines; a final line end opens none."""
    whole = F.regexp_replace(F.col(text), "(?:\r\n|\r|\n)$", "")
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.posexplode(F.split(whole, "\r\n|\r|\n")).alias("line_no", "line"))


def text_blocks(lines: DataFrame, normalize: bool = True) -> DataFrame:
    """(doc_id, line_no, line) -> (doc_id, pos, text, indent, width, top_spacing, bottom_spacing, text_orig).

    Blank lines are dropped after they have told their neighbours of the space; pos counts the lines that stay.
    """
    importable(lines.sparkSession)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    own = lines.withColumn("orig", normalized(F.col("line")) if normalize else F.col("line"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    spaced = own.withColumn("top_spacing", blank(F.lag("orig").over(w))).withColumn("bottom_spacing", blank(F.lead("orig").over(w)))
    kept = spaced.where(~blank(F.col("orig")))
    return kept.select(
        "doc_id", (F.row_number().over(w) - 1).cast("int").alias("pos"), F.trim("orig").alias("text"), (F.length("orig") - F.length(F.ltrim("orig"))).alias("indent"),
        F.length(F.rtrim("orig")).alias("width"), "top_spacing", "bottom_spacing", F.col("orig").alias("text_orig"),
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files (a file, folder or pattern) -> blocks with doc_id = path. Folders: *.txt and *.text."""
    files = spark.read.option("pathGlobFilter", "*.{txt,text}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return text_blocks(split_lines(files))


def read_annotated(blocks: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of files that have an annotation of as many lines, with label and pointer; and (doc_id, problem) of the files left out.

    annotations: (file_key, pos, label, pointer). Excluded lines are dropped and pointers adjusted.
    """
    from .annotations import without_excluded

    keyed = blocks.withColumn("file_key", file_key(F.col("doc_id")))
    wanted = keyed.join(annotations.select("file_key").distinct(), "file_key", "left_semi")
    sizes = wanted.groupBy("doc_id", "file_key").agg(F.count("*").alias("n")).join(annotations.groupBy("file_key").agg(F.count("*").alias("m")), "file_key")
    bad = sizes.where("n <> m").select("doc_id", F.lit("Number of rows does not match labels.").alias("problem"))
    good = wanted.join(sizes.where("n = m").select("doc_id"), "doc_id", "left_semi").join(annotations, ["file_key", "pos"]).drop("file_key")
    return without_excluded(good), bad
