"""Commands: init-dataset, evaluate, train, predict, data-stats, search."""

from __future__ import annotations

import argparse
import importlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics as M
from .operators import structure as S
from .plans import export, model, registry
from .sources.annotations import read_annotations, write_skeletons
from .sources.pdf import READERS
from .sources.text import read_annotated


class UsageError(ValueError):
    """Arguments that do not go together."""


#: The extractor of each kind of file, unless another is named.
DEFAULT = {"text": "text_contract", "txt": "text_contract", "pdf": "pdf_contract", "hocr": "hocr_balance_sheet_ja"}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Blocks of a file or folder; a cell of an hOCR file is a document, its key the path and the cell's number."""
    module, name = READERS[kind].rsplit(".", 1)
    blocks = getattr(importlib.import_module(module), name)(spark, path)
    return blocks.withColumn("doc_id", F.concat_ws("#", "path", F.col("cell_idx").cast("string"))) if kind == "hocr" else blocks


def annotated(spark: SparkSession, kind: str, raw: str, annos: str) -> DataFrame:
    """Blocks that have an annotation, with label and pointer; what is left out is told."""
    blocks = read(spark, kind, raw)
    if kind == "hocr":
        from pyspark.sql.window import Window

        from .sources.text import file_key

        labels = read_annotations(spark, annos, cells=True)
        numbered = blocks.withColumn("file_key", file_key(F.col("path"))).withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("cell_idx", "pos")) - 1)
        return numbered.join(labels.withColumnRenamed("pos", "line"), ["file_key", "line"]).drop("file_key", "line")
    good, bad = read_annotated(blocks, read_annotations(spark, annos))
    for r in bad.take(20):
        print(f'Loading "{r["doc_id"]}" failed. {r["problem"]}')
    return good


def predict(form: str, kind: str, path: str, model_path: str | None = None, models: model.Models | None = None, spark: SparkSession | None = None) -> DataFrame:
    """paragraphs, tabbed or tree of every document at `path`, by a saved model (its path, name or address) or a given one."""
    if (model_path is None) == (models is None):
        raise UsageError("give either a model or the path of one")
    spark = spark or SparkSession.builder.getOrCreate()
    models = models or registry.load(model_path)
    blocks = read(spark, kind, path)
    lines = model.predict(blocks, models).join(blocks.select("doc_id", "pos", "text"), ["doc_id", "pos"])
    if form == "tree":
        return export.tree_json(S.tree(lines))
    paragraphs = S.paragraphs(lines)
    return export.tabbed(paragraphs) if form == "tabbed" else paragraphs.select("doc_id", "para_idx", F.col("text").alias("line"))


def _rows(df: DataFrame, key: str) -> dict:
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lineweave", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    kinds = sorted(READERS)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("kind", choices=kinds)
        for n in names:
            p.add_argument(n)
        return p

    command("init-dataset", "raw", "out")
    p = command("evaluate", "raw", "annos")
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--extractor")
    p.add_argument("--metrics")
    p.add_argument("--prediction")
    command("train", "raw", "annos", "model").add_argument("--extractor")
    command("predict", "path", "model", "out").add_argument("--format", choices=("paragraphs", "tabbed", "tree"), default="paragraphs")
    command("data-stats", "raw", "annos")
    p = command("search", "raw", "annos", "out")
    p.add_argument("--mode", choices=sorted(model.MODES), default="incr-important")
    p.add_argument("--rounds", type=int)
    p.add_argument("--extractor")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "init-dataset":
        write_skeletons(read(spark, a.kind, a.raw), a.out, cells=a.kind == "hocr")
    elif a.command == "predict":
        predict(a.format, a.kind, a.path, a.model, spark=spark).orderBy("doc_id").write.mode("errorifexists").json(a.out)
    else:
        blocks = annotated(spark, a.kind, a.raw, a.annos)
        gold = blocks.select("doc_id", "pos", "label", "pointer")
        own = blocks.drop("label", "pointer")
        extractor = getattr(a, "extractor", None) or DEFAULT[a.kind]
        if a.command == "train":
            model.train(own, gold, extractor).save(a.model)
        elif a.command == "data-stats":
            print(json.dumps(_rows(M.statistics(gold), "measure"), indent=2))
        elif a.command == "search":
            from .plans.features import EXTRACTORS

            def score(used: list[str]) -> float:
                return float(M.label_accuracy(gold, model.cross_predict(own, gold, extractor, used=used)).first()["micro"])

            def done(history: list[dict]) -> None:
                with open(a.out, "w") as f:
                    json.dump(history, f, indent=2)

            model.search(score, sorted(EXTRACTORS[extractor]().line_columns()), a.mode, a.rounds, done=done)
        else:
            found = model.evaluate(own, gold, extractor, a.k)
            scores = {"structure": _rows(found["structure"], "class"), "average_f1": found["average_f1"].first().asDict(), "labels": _rows(found["labels"], "class"), "accuracy": found["accuracy"].first().asDict(), "paragraph_boundary": _rows(found["paragraph_boundary"], "class")["paragraph_boundary"]}
            found["confusion"].show(truncate=False)
            if a.prediction:
                export.write_json(export.prediction_json(own, gold, found["predictions"]), a.prediction)
            if a.metrics:
                os.makedirs(os.path.dirname(os.path.abspath(a.metrics)), exist_ok=True)
                with open(a.metrics, "w") as f:
                    json.dump(scores, f, indent=2)
            else:
                print(json.dumps(scores, indent=2))


if __name__ == "__main__":
    main()
