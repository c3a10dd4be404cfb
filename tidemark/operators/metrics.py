"""Exact classification metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import known, share
from tidemark.operators.slices import Bounds, slice_bounds, sum_before
from tidemark.operators.top_rows import first_per_key

METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc")
COUNTS = ("tn", "fp", "fn", "tp")


def _confusion() -> list[Column]:
    def cell(truth: int, predicted: int) -> Column:
        return F.count_if((F.col("target_up") == truth) & (F.col("y_pred") == predicted))

    return [
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
        F.count("*").alias("n_obs"),
    ]


def confusion_counts(predictions: DataFrame, group: Sequence[str]) -> DataFrame:
    return predictions.dropna(subset=list(group)).groupBy(*group).agg(*_confusion())


def class_metrics(counts: DataFrame) -> DataFrame:
    """Adds the threshold metrics to confusion counts; an empty denominator gives 0.

    Balanced accuracy is the mean recall of the classes that occur.
    """
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    recall_up, recall_down = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    seen = recall_up.isNotNull().cast("int") + recall_down.isNotNull().cast("int")
    balanced = F.try_divide(
        F.coalesce(recall_up, F.lit(0.0)) + F.coalesce(recall_down, F.lit(0.0)), seen
    )
    return counts.withColumns(
        {
            "accuracy": share(tp + tn, tp + tn + fp + fn),
            "balanced_accuracy": balanced,
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
        }
    )


def with_scores(predictions: DataFrame) -> DataFrame:
    """A NaN score is no score."""
    return predictions.withColumn("y_score", known(F.col("y_score")))


def _classes() -> list[Column]:
    """Rows of each class that carry a score; rows without one rank nowhere."""
    scored = F.col("y_score").isNotNull()
    return [
        F.count_if(scored & (F.col("target_up") == 1)).alias("pos"),
        F.count_if(scored & (F.col("target_up") == 0)).alias("neg"),
    ]


def _area() -> Column:
    """Pairs a positive wins over a negative, ties half, over all pairs; null for one class."""
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / F.lit(2.0)))
    return F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def _ranked(
    predictions: DataFrame, group: Sequence[str], measures: list[Column], bounds: Bounds | None
) -> DataFrame:
    """Counts per distinct score, with the negatives at lower scores of the group.

    Rows without a group drop out. Rows are counted per score before any window runs, and the running sum is sliced, so a
    group may hold any number of scores. Bounds come from the rows, without a shuffle.
    """
    predictions = with_scores(predictions).dropna(subset=list(group))
    if bounds is None:
        bounds = slice_bounds(predictions, [*group, "y_score"])
    counts = predictions.groupBy(*group, "y_score").agg(*measures)
    return sum_before(counts, group, ["y_score"], ["neg"], bounds=bounds)


def roc_auc(predictions: DataFrame, group: Sequence[str], bounds: Bounds | None = None) -> DataFrame:
    """(group, roc_auc): the exact, tie-aware area; null for one class."""
    scored = with_scores(predictions).where(F.col("y_score").isNotNull() & F.col("target_up").isNotNull())
    return _ranked(scored, group, _classes(), bounds).groupBy(*group).agg(_area().alias("roc_auc"))


def classification_metrics(
    predictions: DataFrame, group: Sequence[str], bounds: Bounds | None = None
) -> DataFrame:
    """All metrics and counts per group, from (target_up, y_pred, y_score) rows, without a join.

    Where a score is null in some row of a group there is no area for the group.
    """
    measures = [*_confusion(), *_classes(), F.count_if(F.col("y_score").isNull()).alias("_unscored")]
    totals = _ranked(predictions, group, measures, bounds).groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "n_obs")],
        F.when(F.sum("_unscored") == 0, _area()).alias("roc_auc"),
    )
    return class_metrics(totals).select(*group, *METRICS, *COUNTS, "n_obs")


def metrics_by_asset(predictions: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Metrics per (model, asset), each (week, asset, model) counted once."""
    once = first_per_key(predictions, ["week_start", "asset", "model"], [F.col("y_pred")])
    return classification_metrics(once, ["model", "asset"], bounds)


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean balanced accuracy per model, best first."""
    return (
        fold_metrics.groupBy("model")
        .agg(F.avg("balanced_accuracy").alias("cv_balanced_accuracy_mean"))
        .orderBy(F.col("cv_balanced_accuracy_mean").desc(), "model")
    )


def confusion_shares(metrics: DataFrame) -> DataFrame:
    """Adds each confusion cell as a percentage of all four; 0 for no rows."""
    total = sum((F.col(c) for c in COUNTS), F.lit(0))
    return metrics.withColumns({f"{c}_pct": share(F.col(c), total) * 100.0 for c in COUNTS})


def class_weights(rows: DataFrame, label: str = "target_up") -> DataFrame:
    """(label, n, weight) with weight n_all / (2 n_class); the window sees one row per class."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", (total / (F.lit(2.0) * F.col("n"))).alias("weight"))
