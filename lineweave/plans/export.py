"""What the engine writes: predictions, tabbed paragraphs, trees and span relations as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import per_document
from ..operators.structure import ELIMINATE, LABELS, related_lines

_NAME = "element_at(array({}), {{0}} + 1)".format(", ".join(f"'{n}'" for n in (*LABELS, "ADDRESS")))


def tabbed(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, line): a tab for each level before the text."""
    return paragraphs.select("doc_id", "para_idx", F.concat(F.expr("repeat('\t', level)"), F.col("text")).alias("line"))


def tree_json(tree: DataFrame) -> DataFrame:
    """(doc_id, value): the nodes of each document as one JSON array."""
    nodes = F.sort_array(F.collect_list(F.struct("node", "text", "siblings", "ancestors", "parent", "descendents", "children", "eliminated")))
    return tree.groupBy("doc_id").agg(nodes.alias("nodes")).select("doc_id", F.to_json("nodes").alias("value"))


def prediction_json(lines: DataFrame, gold: DataFrame, pred: DataFrame, features: DataFrame | None = None, path: str = "doc_id") -> DataFrame:
    """(doc_id, value): a JSON object for each document: texts, features, accuracy, gold and predicted labels and pointers."""
    side = lambda df, name: df.select("doc_id", "pos", F.expr(_NAME.format("label")).alias(f"{name}_label"), F.col("pointer").alias(f"{name}_pointer"))
    rows = lines.select("doc_id", "pos", "text").join(side(gold, "gold"), ["doc_id", "pos"]).join(side(pred, "pred"), ["doc_id", "pos"])
    if features is not None:
        names = sorted(c for c in features.columns if c not in ("doc_id", "pos"))
        rows = rows.join(features.select("doc_id", "pos", F.array(*names).alias("features")), ["doc_id", "pos"], "left")
    else:
        rows = rows.withColumn("features", F.array().cast("array<double>"))
    each = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "features", "gold_label", "gold_pointer", "pred_label", "pred_pointer"))).alias("r"))
    accuracy = F.expr("size(filter(r, x -> x.gold_label = x.pred_label)) / size(r)")
    # array of nulls must keep its nulls, so pointers are -1 where there is none
    pointers = lambda c: F.expr(f"transform(r, x -> coalesce(x.{c}, -1))")
    made = F.struct(
        F.col(path).cast("string").alias("path"), F.col("r.text").alias("texts"), F.col("r.features").alias("features"), accuracy.alias("transition_prediction_accuracy"),
        F.struct(F.col("r.gold_label").alias("labels"), pointers("gold_pointer").alias("pointers")).alias("ground_truth"), F.struct(F.col("r.pred_label").alias("labels"), pointers("pred_pointer").alias("pointers")).alias("prediction"),
    )
    return each.select("doc_id", F.to_json(made).alias("value"))


_KINDS = ("continual", "siblings", "ancestors", "parent", "descendents", "children")
_ENTRIES = f"array<struct<id:string,own:struct<text:string,{','.join(f'{k}:array<string>' for k in _KINDS)}>>>"


def _entries(rows: list[tuple], strict: bool) -> list[tuple]:
    """rows (pos, label, pointer, text, blocks) of a document -> (id, (text, span ids of each relation)) in the order of the ids; a span of several lines is that of the first."""
    lines: dict[int, list[str]] = {}
    for pos, *_, blocks in rows:
        lines.setdefault(pos, []).extend(x for x in blocks or [] if x is not None)
    made: dict[str, tuple] = {}
    texts = {r[0]: r[3] for r in reversed(rows)}
    for pos, *relations in related_lines([r[:3] for r in rows], strict):
        if not lines[pos]:
            continue
        continual, siblings, ancestors, parent, descendents, children = relations
        own = (texts[pos], *(sorted({x for p in others for x in lines.get(p, ())}) for others in (continual, siblings, ancestors, [] if parent is None else [parent], descendents, children)))
        for x in lines[pos]:
            made.setdefault(x, own)
    return sorted(made.items(), key=lambda e: e[0].encode("utf-8", "surrogatepass"))


def relation_json(lines: DataFrame, by: str = "doc_id", strict: bool = False) -> DataFrame:
    """lines(doc_id, pos, label, pointer, text, blocks) -> (doc_id, value): span id -> text and the span ids in each relation.

    A line's spans share its relations; spans of the same line are not related to each other. One exchange gathers a
    document's lines, and one pass over them gives the whole map, so no pair of related lines is dealt out.
    """
    rows = lines.select(by, "pos", F.coalesce("label", F.lit(ELIMINATE)).alias("label"), "pointer", "text", "blocks")

    def fold(found: list[tuple]) -> list[tuple]:
        entries = _entries(found, strict)
        return [([{"id": k, "own": dict(zip(("text", *_KINDS), own, strict=True))} for k, own in entries],)] if entries else []

    made = per_document(rows, ["pos", "label", "pointer", "text", "blocks"], fold, f"m {_ENTRIES}", (by,))
    return made.select(by, F.to_json(F.map_from_entries("m")).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a line."""
    rows.select("value").write.mode("errorifexists").text(path)
