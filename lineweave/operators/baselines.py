"""Rule baselines: labels and pointers from indents, numbering or extractor blocks, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import CONSECUTIVE, DOWN as OPENED, NO_NUM, UNKNOWN, UP as RESUMED, NumberedList
from .fold import per_document
from .layout import belongs, clusters, index_of, spacing
from .structure import CONTINUOUS, DOWN, SAME_LEVEL, UP

LABELLED = "pos int, label int, pointer int"


def _by_depth(rows: list[tuple]) -> list[tuple]:
    """rows (pos, depth, starts) -> labels: what a line is to the next one. A step back points at the last open line of equal depth.

    Lines that a search passes are closed for all later ones. Without a line of equal depth, and on the last line, the
    pointer is -1.
    """
    out: list[tuple] = []
    open_lines: list[tuple[int, int]] = [(rows[0][0], rows[0][1])]
    for (pos, before, _), (here, depth, starts) in zip(rows, rows[1:], strict=False):
        if depth == before:
            out.append((pos, SAME_LEVEL if starts else CONTINUOUS, None))
        elif depth > before:
            out.append((pos, DOWN, None))
        else:
            while open_lines and open_lines[-1][1] != depth:
                open_lines.pop()
            out.append((pos, UP, open_lines[-1][0] if open_lines else -1))
        open_lines.append((here, depth))
    return [*out, (rows[-1][0], UP, -1)]


def by_indent(lines: DataFrame) -> DataFrame:
    """lines(doc_id, pos, indent, top_spacing) -> (doc_id, pos, label, pointer)."""
    rows = lines.select("doc_id", "pos", F.coalesce("indent", F.lit(0)).alias("indent"), F.coalesce("top_spacing", F.lit(False)).alias("top_spacing"))
    return per_document(rows, ["pos", "indent", "top_spacing"], _by_depth, LABELLED)


def by_position(boxes: DataFrame, thresh: float = 10.0) -> DataFrame:
    """boxes(doc_id, pos, page, x0, y0, ...) -> (doc_id, pos, label, pointer): clusters of left edges are the depths.

    A line starts a block unless it follows the one before it on the same page at the document's line spacing.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    known = boxes.join(clusters(boxes, "x0", thresh, "left_clusters"), "doc_id").join(spacing(boxes), "doc_id", "left")
    known = known.withColumn("gap", F.when(F.lag("page").over(w) == F.col("page"), F.lag("y0").over(w) - F.col("y0")))
    rows = known.select("doc_id", "pos", index_of("x0", "left_clusters").alias("depth"), (~belongs("gap", "line_spacing")).alias("starts"))
    return per_document(rows, ["pos", "depth", "starts"], _by_depth, LABELLED)


def _by_number(rows: list[tuple]) -> list[tuple]:
    listing = NumberedList()
    made: list[tuple[int, int | None]] = []
    for k, (_, found) in enumerate(rows):
        state, anchor = listing.push([(c["kind"], c["num"], c["bullet"]) for c in found or []], k)
        label = {NO_NUM: CONTINUOUS, CONSECUTIVE: SAME_LEVEL, OPENED: DOWN, RESUMED: UP, UNKNOWN: SAME_LEVEL}[state]
        made.append((label, rows[anchor][0] if state == RESUMED else None))
    made = [*made[1:], (UP, -1)]
    return [(pos, label, pointer) for (pos, _), (label, pointer) in zip(rows, made, strict=True)]


def by_numbering(lines: DataFrame, candidates: str = "candidates") -> DataFrame:
    """lines(doc_id, pos, candidates) -> (doc_id, pos, label, pointer): how each next line's number goes on."""
    return per_document(lines.select("doc_id", "pos", F.col(candidates).alias("found")), ["pos", "found"], _by_number, LABELLED)


def by_blocks(boxes: DataFrame) -> DataFrame:
    """boxes(doc_id, pos, blocks array<string>) -> (doc_id, pos, label, pointer): lines that share a block go on."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    after = F.lead("blocks").over(w)
    last = F.lead("pos").over(w).isNull()
    label = F.when(last, UP).when(F.coalesce(F.arrays_overlap("blocks", after), F.lit(False)), CONTINUOUS).otherwise(SAME_LEVEL)
    return boxes.select("doc_id", "pos", label.alias("label"), F.when(last, F.lit(-1)).cast("int").alias("pointer"))


def numbered_list_states(lines: DataFrame, candidates: str = "candidates") -> DataFrame:
    """lines(doc_id, pos, candidates) -> (doc_id, pos, state) of the numbered list after each line."""

    def fold(rows: list[tuple]) -> list[tuple]:
        listing = NumberedList()
        return [(pos, listing.push([(c["kind"], c["num"], c["bullet"]) for c in found or []])[0]) for pos, found in rows]

    return per_document(lines.select("doc_id", "pos", F.col(candidates).alias("found")), ["pos", "found"], fold, "pos int, state int")
