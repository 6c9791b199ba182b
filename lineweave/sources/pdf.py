"""PDF files, through a parser that may be installed; and boxes, the form in which the engine takes them."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators.fold import importable
from ..operators.layout import merge_lines

BOXES = "doc_id string, pos int, page int, x0 double, y0 double, x1 double, y1 double, text string, blocks array<string>"


def _boxes(content: bytes, key: str) -> Iterator[tuple]:
    """Lines of a PDF in the order of its layout. A text box is a block; lines outside any share the one of the page's first such line."""
    try:
        from pdfminer.high_level import extract_pages
        from pdfminer.layout import LTChar, LTFigure, LTTextBox, LTTextLine
    except ImportError as error:
        raise RuntimeError("reading PDF files needs the package pdfminer.six; give boxes as a table instead") from error
    made = 0

    def walk(layout, page: int, block: str | None) -> Iterator[tuple]:
        nonlocal made
        for item in layout:
            if isinstance(item, (LTTextLine, LTChar)):
                if block is None:
                    block, made = f"{key}#{page}#{made}", made + 1
                yield page, *map(float, item.bbox), item.get_text().strip("\n"), [block]
            elif isinstance(item, LTTextBox):
                own, made = f"{key}#{page}#{made}", made + 1
                yield from walk(item, page, own)
            elif isinstance(item, LTFigure):
                yield from walk(item, page, block)

    for k, page in enumerate(extract_pages(io.BytesIO(content))):
        yield from walk(page, k + 1, None)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """*.pdf files of a folder -> boxes, one for each line: (doc_id = path, pos, page, x0, y0, x1, y1, text, blocks)."""
    importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, k, *r) for p, c in zip(part["path"], part["content"], strict=True) for k, r in enumerate(_boxes(c, p))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BOXES.split(", ")])

    boxes = files.mapInPandas(run, BOXES).withColumn("text", normalized(F.col("text"))).where(F.trim("text") != "")
    return merge_lines(boxes)


def from_table(boxes: DataFrame) -> DataFrame:
    """Boxes from a table, lines merged."""
    return merge_lines(boxes)


#: Readers by the kind of file.
READERS = {"text": "lineweave.sources.text.read_text", "txt": "lineweave.sources.text.read_text", "pdf": "lineweave.sources.pdf.read_pdf", "hocr": "lineweave.sources.hocr.read_hocr"}
