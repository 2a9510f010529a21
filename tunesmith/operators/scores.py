"""Scores of predictions as grouped aggregates.

Rates come from one count by (label, prediction). Ranking scores are exact: the area under the ROC curve
of a class is the tie-averaged rank sum of its rows (Mann-Whitney), with ranks from a prefix scan over
counts by distinct score, not from a grid of thresholds.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.linalg import VectorUDT

from tunesmith.operators.scan import running

# The metric names users know, as (quantity, average).
RATES = {
    "accuracy": ("accuracy", None),
    "balanced_accuracy": ("recall", "macro"),
    "precision": ("precision", "binary"), "recall": ("recall", "binary"), "f1": ("f1", "binary"),
    "precision_macro": ("precision", "macro"), "recall_macro": ("recall", "macro"), "f1_macro": ("f1", "macro"),
    "precision_micro": ("precision", "micro"), "recall_micro": ("recall", "micro"), "f1_micro": ("f1", "micro"),
    "precision_weighted": ("precision", "weighted"), "recall_weighted": ("recall", "weighted"), "f1_weighted": ("f1", "weighted"),
    "weightedPrecision": ("precision", "weighted"), "weightedRecall": ("recall", "weighted"),
}
#: Multi-class ranking: whether classes weigh by their rows.
RANKING = {"roc_auc_ovr": False, "roc_auc_ovr_weighted": True}
BINARY = {"roc_auc": "areaUnderROC", "average_precision": "areaUnderPR"}
LOSSES = {"neg_log_loss": "logLoss", "logLoss": "logLoss", "hammingLoss": "hammingLoss"}


def names() -> list[str]:
    return [*RATES, *RANKING, *BINARY, *LOSSES]


def class_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, tp, fp, fn, support) of every class that is a label or a prediction."""
    cells = pred.groupBy(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("z")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("y") == F.col("z")
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("z").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
                 F.lit(0).cast("long").alias("fn")))).alias("c")).select("c.*").where("class is not null")
    return sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("support", F.col("tp") + F.col("fn"))


def _share(hits: Column, all_: Column) -> Column:
    return F.when(all_ > 0, hits / all_).otherwise(0.0)


def rates(counts: DataFrame) -> DataFrame:
    """``class_counts`` with precision, recall and f1; a rate without rows is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn)})


def rate(pred: DataFrame, label: str, name: str, prediction: str = "prediction") -> float:
    """One of RATES. ``macro`` averages over the classes, ``weighted`` by their rows, ``micro`` pools them, ``binary`` is class 1's."""
    quantity, average = RATES[name]
    if quantity == "accuracy":
        return float(pred.agg(F.avg((F.col(prediction) == F.col(label)).cast("double"))).first()[0])
    counts = class_counts(pred, label, prediction)
    if average == "micro":
        counts = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    by_class = rates(counts)
    if average == "binary":
        by_class = by_class.where("class = 1")
    if average == "macro" and name == "balanced_accuracy":
        by_class = by_class.where("support > 0")
    value = F.sum(F.col(quantity) * F.col("support")) / F.sum("support") if average == "weighted" else F.avg(quantity)
    return float(by_class.agg(value).first()[0] or 0.0)


def auc_by_class(scored: DataFrame, label: Column, class_scores: Column) -> DataFrame:
    """(class, positives, rows, auc): the area under each class's ROC curve, one against the rest.

    ``class_scores`` is an array with a score for class 0, 1, ...; ``label`` a class number. Equal scores share their
    mean rank. A class with all or no rows has no area (null). Rows whose label or array is null take no part; a
    null or NaN score counts as the lowest. Rows become counts by (class, score) before anything is ordered.
    """
    rows = scored.select(label.cast("int").alias("y"), F.posexplode(class_scores).alias("class", "score")).where("y is not null")
    low = F.when(F.col("score").isNull() | F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score").cast("double"))
    counts = rows.groupBy("class", low.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == F.col("class")).alias("pos"))
    ranked = running(counts, ["class"], ["score"], [("upto", "sum", "n")])
    mean_rank = F.col("upto") - (F.col("n") - 1) / 2
    sums = ranked.groupBy("class").agg(F.sum(F.col("pos") * mean_rank).alias("r"), F.sum("pos").alias("positives"), F.sum("n").alias("rows"))
    p, rest = F.col("positives"), F.col("rows") - F.col("positives")
    return sums.select("class", "positives", "rows", F.when((p > 0) & (rest > 0), (F.col("r") - p * (p + 1) / 2) / (p * rest)).alias("auc"))


def mean_auc(pred: DataFrame, label: str, weighted: bool = False, probability: str = "probability") -> float:
    """The areas averaged over the classes that have one, by their rows if ``weighted``."""
    p = F.col(probability)
    if isinstance(pred.schema[probability].dataType, VectorUDT):
        p = vector_to_array(p)
    areas = auc_by_class(pred, F.col(label), p).where("auc is not null")
    value = F.sum(F.col("auc") * F.col("positives")) / F.sum("positives") if weighted else F.avg("auc")
    found = areas.agg(value).first()[0]
    if found is None:
        raise ValueError("no class has both rows of its own and others")
    return float(found)
