"""hOCR files: the table cells of each page as documents of spans."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators.fold import SLICE_BYTES, SLICE_ROWS, importable, per_document
from ..operators.layout import merged_lines

SPANS = "cell_idx int, x0 double, y0 double, x1 double, y1 double, cell_w double, cell_h double, text string, blocks array<string>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Node:
    """An element; it doesn't know its parent, so a page's tree goes as soon as it is let go."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def find(self, tag: str) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag == tag:
                    yield c
                yield from c.find(tag)

    def text(self) -> str:
        return "".join(c.text() if isinstance(c, _Node) else c for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.open.append(self.open[-1].children[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        at = len(self.open) - 1
        while at and self.open[at].tag != tag:
            at -= 1
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def title_fields(title: str) -> dict[str, list[str]]:
    """`bbox 0 0 100 40; x_conf 3` -> {bbox: [...], x_conf: [...]}; ValueError for a field that is there twice."""
    out: dict[str, list[str]] = {}
    for part in title.split(";"):
        name, *values = part.split()or [""]
        if not name:
            continue
        if name in out:
            raise ValueError(f"{name} is there twice in {title!r}")
        out[name] = values
    return out


def _box(node: _Node) -> tuple[float, ...] | None:
    found = title_fields(node.attrs.get("title", "")).get("bbox")
    return tuple(map(float, found[:4])) if found and len(found) >= 4 else None


def cells_of(html: str) -> list[list[tuple]]:
    """Spans of each table cell with more than one of them, relative to the cell, the y axis upwards.

    Nested tables are gone through again for each table around them, as a recursive search does.
    """
    builder = _Builder()
    builder.feed(html)
    builder.close()
    out = []
    for page in builder.root.find("div"):
        if "ocr_page" not in page.attrs.get("class", "").split():
            continue
        for table in page.find("table"):
            for cell in table.find("td"):
                spans, frame = list(cell.find("span")), _box(cell)
                if len(spans) < 2 or frame is None:
                    continue
                left, top, right, bottom = frame
                width, height, rows = right - left, bottom - top, []
                for span in spans:
                    box = _box(span)
                    text = span.text().strip("\n")
                    if box is None or not text.strip():
                        continue
                    if box[0] > box[2] or box[1] > box[3]:
                        raise ValueError(f"a box with its corners crossed: {span.attrs.get('title')!r}")
                    rows.append((box[0] - left, bottom - box[3], box[2] - left, bottom - box[1], width, height, text, [span.attrs.get("title", "")]))
                if rows:
                    out.append(rows)
    return out


def spans(pages: DataFrame, key: str = "path", html: str = "html") -> DataFrame:
    """pages(path, html) -> (path, cell_idx, x0, y0, x1, y1, cell_w, cell_h, text, blocks). Null html: no cells.

    A worker holds one page's tree at a time, and sends spans on as soon as they come of about SLICE_BYTES of html.
    """
    importable(pages.sparkSession)
    out = f"path {dict(pages.dtypes)[key]}, {SPANS}"
    arrow = pages.sparkSession.createDataFrame([], out).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, held = [], [], 0
            for n in range(b.num_rows):
                page = b.column("h")[n].as_py()
                if page is not None:
                    for c, cell in enumerate(cells_of(page)):
                        rows += [(c, *s) for s in cell]
                    at += [n] * (len(rows) - len(at))
                    held += len(page)
                if rows and (n + 1 == b.num_rows or held >= SLICE_BYTES or len(rows) >= SLICE_ROWS):
                    own = [b.column("k").take(pa.array(at, pa.int32())), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(own, schema=pa.schema([pa.field("path", own[0].type), *list(arrow)[1:]]))
                    at, rows, held = [], [], 0

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInArrow(run, out)


def _cell(rows: list[tuple]) -> list[tuple]:
    """Boxes of a cell (as merged_lines takes them, then the cell's width and height) -> its lines, or none if it has one."""
    lines = merged_lines([r[:7] for r in rows])
    return [(pos, *line, *rows[0][7:]) for pos, _, *line in lines] if len(lines) > 1 else []


def cell_blocks(found: DataFrame) -> DataFrame:
    """Spans with normalised texts, merged to lines; cells with one line are left out. (path, cell_idx, pos, x0, ..., text, blocks, cell_w, cell_h)."""
    importable(found.sparkSession)
    rows = found.select("path", "cell_idx", F.lit(0).alias("page"), (-F.col("y0")).alias("ny0"), "x0", "x1", "y1", normalized(F.col("text")).alias("text"), F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"), "cell_w", "cell_h")
    columns = ["page", "ny0", "x0", "x1", "y1", "text", "blocks", "cell_w", "cell_h"]
    return per_document(rows, columns, _cell, "pos int, x0 double, y0 double, x1 double, y1 double, text string, blocks array<string>, cell_w double, cell_h double", ("path", "cell_idx"))


def read_hocr(spark: SparkSession, path: str) -> DataFrame:
    """*.hocr files of a folder -> cell blocks."""
    files = spark.read.option("pathGlobFilter", "*.hocr").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return cell_blocks(spans(files))
