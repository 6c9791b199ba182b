"""Scores of predicted labels and structure against gold ones, and statistics of annotated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structure import DOWN, LABELS, SAME_LEVEL, UP, hierarchy, max_depth

STRUCTURE = ("same_paragraph", "same_level", "parent_child")


def _ratios(prefix: str = "") -> list[Column]:
    """Precision, recall and F1 of counts tp, fp, fn; 0 where nothing is there."""
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f = F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return [p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), f.alias(f"{prefix}f1")]


def _scores(counts: DataFrame) -> DataFrame:
    """counts(doc_id, class, tp, fp, fn, tn) -> a row for each class: micro scores and counts, macro scores over documents that have the class."""
    micro = counts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).select("class", *_ratios("micro_"), F.col("tp").alias("true_positive"), F.col("fp").alias("false_positive"), F.col("fn").alias("false_negative"), F.col("tn").alias("true_negative"))
    each = counts.where("tp + fn > 0").select("class", *_ratios())
    macro = each.groupBy("class").agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return micro.join(macro, "class", "left")


def _counts(pairs: DataFrame, classes: list[tuple[str, Column, Column]]) -> DataFrame:
    """pairs(doc_id, ...) -> (doc_id, class, tp, fp, fn, tn): one aggregation for all classes."""
    one = lambda c: F.sum(c.cast("long"))
    made = [F.struct(F.lit(name).alias("class"), one(g & p).alias("tp"), one(~g & p).alias("fp"), one(g & ~p).alias("fn"), one(~g & ~p).alias("tn")) for name, g, p in classes]
    return pairs.groupBy("doc_id").agg(*[m.alias(f"c{k}") for k, m in enumerate(made)]).select("doc_id", F.explode(F.array(*[f"c{k}" for k in range(len(made))])).alias("x")).select("doc_id", "x.*")


def paired(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, pos, gold, pred) of labels at the same place."""
    return gold.select("doc_id", "pos", F.col("label").alias("gold")).join(pred.select("doc_id", "pos", F.col("label").alias("pred")), ["doc_id", "pos"])


def label_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each of the five labels."""
    return _scores(_counts(paired(gold, pred), [(name, F.col("gold") == k, F.col("pred") == k) for k, name in enumerate(LABELS)]))


def boundary_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: DOWN, UP and SAME_LEVEL against the rest."""
    ends = lambda c: F.col(c).isin(SAME_LEVEL, DOWN, UP)
    return _scores(_counts(paired(gold, pred), [("paragraph_boundary", ends("gold"), ends("pred"))]))


def label_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: micro and macro (mean over documents) accuracy."""
    each = paired(gold, pred).groupBy("doc_id").agg(F.sum((F.col("gold") == F.col("pred")).cast("long")).alias("right"), F.count("*").alias("n"))
    return each.agg((F.sum("right") / F.sum("n")).alias("micro"), F.avg(F.col("right") / F.col("n")).alias("macro"))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each gold label, a column for each predicted one, zeros included; ADDRESS too."""
    names = [*LABELS, "ADDRESS"]
    all_rows = gold.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names)], "code int, gold string")
    counts = paired(gold, pred).groupBy("gold").agg(*[F.sum((F.col("pred") == k).cast("long")).alias(n) for k, n in enumerate(names)])
    return F.broadcast(all_rows).join(counts.withColumnRenamed("gold", "code"), "code", "left").select("gold", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def structure_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each relation, over all pairs of lines of a document; pairs in no relation count as negatives.

    Only related pairs are joined; the rest are counted from the number of lines.
    """
    g = hierarchy(gold).withColumnRenamed("rel", "gold")
    p = hierarchy(pred).withColumnRenamed("rel", "pred")
    sizes = gold.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.expr("n * (n - 1) div 2").alias("pairs"))
    both = g.join(p, ["doc_id", "i", "j"], "full").select("doc_id", F.coalesce("gold", F.lit(-1)).alias("gold"), F.coalesce("pred", F.lit(-1)).alias("pred"))
    counts = _counts(both, [(name, F.col("gold") == k, F.col("pred") == k) for k, name in enumerate(STRUCTURE)]).drop("tn")
    empty = sizes.join(both.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.explode(F.array(*map(F.lit, STRUCTURE))).alias("class"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    counts = counts.unionByName(empty).join(sizes, "doc_id").withColumn("tn", F.col("pairs") - F.col("tp") - F.col("fp") - F.col("fn")).drop("pairs")
    return _scores(counts)


def average_f1(scores: DataFrame) -> DataFrame:
    """One row: the mean of the classes' micro and of their macro F1."""
    return scores.agg(F.avg("micro_f1").alias("micro"), F.avg("macro_f1").alias("macro"))


def _measures(c: str) -> Column:
    return F.struct(F.median(c).alias("median"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("max"), F.min(c).cast("double").alias("min"))


def statistics(lines: DataFrame) -> DataFrame:
    """lines(doc_id, pos, label, pointer) -> (measure, median, mean, max, min): sizes, depths, label counts and ratios over documents."""
    names = [n.lower() for n in LABELS]
    each = lines.groupBy("doc_id").agg(F.count("*").alias("n_text_blocks"), *[F.sum((F.col("label") == k).cast("long")).alias(f"count_{n}") for k, n in enumerate(names)])
    each = each.join(max_depth(lines), "doc_id").select("*", *[(F.col(f"count_{n}") / F.col("n_text_blocks")).alias(f"ratio_{n}") for n in names])
    columns = ["n_text_blocks", "max_depth", *[f"count_{n}" for n in names], *[f"ratio_{n}" for n in names]]
    one = each.agg(*[_measures(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("m")) for c in columns])).alias("x")).select("x.measure", "x.m.*")
