"""Derived tables that the queries run over: lines with a layout, boxes, gold and predicted labels, all from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = """
SELECT doc_id, pos, CAST(2 * ((doc_id * 7 + pos * 3) % 4) AS INT) AS indent, ((doc_id + pos) % 3 = 0) AS top_spacing,
    concat(CASE pos % 5 WHEN 1 THEN concat(CAST(pos AS STRING), '. ') WHEN 2 THEN '(a) ' WHEN 3 THEN 'ii) ' ELSE '' END, text) AS text
FROM v_lines"""

BOXES = """
SELECT doc_id, pos, CAST(FLOOR(pos / 12.0) AS INT) + 1 AS page, CAST(72 + 9 * ((doc_id * 7 + pos * 3) % 4) AS DOUBLE) AS x0,
    CAST(750 - 14 * (pos % 12) - (CASE WHEN (doc_id + pos) % 3 = 0 THEN 6 ELSE 0 END) AS DOUBLE) AS y0,
    CAST(LEAST(540, 72 + 9 * ((doc_id * 7 + pos * 3) % 4) + 5 * LENGTH(text)) AS DOUBLE) AS x1,
    CAST(760 - 14 * (pos % 12) - (CASE WHEN (doc_id + pos) % 3 = 0 THEN 6 ELSE 0 END) AS DOUBLE) AS y1,
    CAST(FLOOR(pos / 3.0) AS INT) AS block, text
FROM v_layout"""


def _labels(extra: str) -> str:
    return f"""
SELECT doc_id, pos, CAST(CASE WHEN raw = 3 AND dn IS NULL THEN 1 ELSE raw END AS INT) AS label, CASE WHEN raw = 3 THEN dn END AS pointer
FROM (SELECT doc_id, pos, raw, MAX(CASE WHEN raw = 2 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dn
    FROM (SELECT doc_id, pos, CASE WHEN h < 4 THEN 0 WHEN h < 6 THEN 1 WHEN h < 8 THEN 2 WHEN h < 9 THEN 3 ELSE 4 END AS raw
        FROM (SELECT doc_id, pos, (doc_id * 31 + pos * 17{extra}) % 10 AS h FROM v_lines) q0) q1) q2"""


GOLD, PRED = _labels(""), _labels(" + (CASE WHEN (doc_id * 13 + pos * 29) % 7 = 0 THEN 3 ELSE 0 END)")

#: The same tables in DuckDB, as the head of a query.
DUCK_LINES = """
SELECT doc_id, CAST(pos AS INT) AS pos, line AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"""
DUCK = f"WITH RECURSIVE v_lines AS ({DUCK_LINES}), v_layout AS ({LAYOUT}), v_boxes AS ({BOXES}), v_gold AS ({GOLD}), v_pred AS ({PRED})"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def _over(df: DataFrame, name: str, sql: str) -> DataFrame:
    return df.sparkSession.sql(sql.replace(name, "{df}"), df=df)


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(lines(spark, sf_dir), "v_lines", LAYOUT)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(layout(spark, sf_dir), "v_layout", BOXES)


def block_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).withColumn("blocks", F.array(F.col("block").cast("string")))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(lines(spark, sf_dir), "v_lines", GOLD)


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(lines(spark, sf_dir), "v_lines", PRED)


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout lines as text blocks, indented by blanks."""
    own = layout(spark, sf_dir).withColumn("text", F.trim("text")).where("text <> ''")
    orig = F.concat(F.repeat(F.lit(" "), F.col("indent")), F.col("text"))
    return own.withColumn("text_orig", orig).withColumn("width", F.length("text_orig")).withColumn("bottom_spacing", F.lit(False))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut at their first blank, the pieces beside each other on the line."""
    at = F.instr("text", " ")
    b = block_boxes(spark, sf_dir).withColumn("at", at)
    pieces = F.when(at > 1, F.array(F.struct(F.lit(0).alias("k"), F.substring("text", F.lit(1), at - 1).alias("piece")), F.struct(F.lit(1).alias("k"), F.expr("substring(text, at + 1)").alias("piece")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("piece"))))
    cut = b.select("doc_id", "page", "x0", "y0", "x1", "y1", "blocks", F.explode(pieces).alias("p"))
    half = (F.col("x0") + F.col("x1")) / 2
    return cut.select("doc_id", "page", F.when(F.col("p.k") == 0, F.col("x0")).otherwise(half + 6).alias("x0"), "y0", F.when((F.col("p.k") == 0), half).otherwise(F.col("x1")).alias("x1"), "y1", F.col("p.piece").alias("text"), "blocks")
