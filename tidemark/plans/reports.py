"""Report tables over posts, panel, predictions and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_start
from tidemark.operators.folds import fold_timeline
from tidemark.operators.metrics import confusion_shares, metrics_by_asset
from tidemark.operators.top_rows import first_per_key, latest_rows
from tidemark.settings import StudySettings
from tidemark.sources.files import save_table

# Row order of the model-by-asset table.
MODEL_ORDER = (
    "naive_persistence", "market_logreg", "text_logreg", "hybrid_logreg", "linear_svm", "random_forest",
)


def coverage_summary(posts: DataFrame, panel: DataFrame) -> DataFrame:
    """Posts and panel rows per asset, with their time spans; assets of either side appear."""
    post_side = posts.where(F.col("asset").isNotNull()).groupBy("asset").agg(
        F.count("source_id").alias("posts"),
        F.min("created_utc").alias("posts_start"),
        F.max("created_utc").alias("posts_end"),
    )
    panel_side = panel.where(F.col("asset").isNotNull()).groupBy("asset").agg(
        F.count("week_start").alias("weekly_rows"),
        F.min("week_start").alias("weekly_start"),
        F.max("week_start").alias("weekly_end"),
        F.avg("target_up").alias("target_up_share"),
    )
    return post_side.join(panel_side, "asset", "outer")


def weekly_post_volume(posts: DataFrame, anchor: str = "W-SUN") -> DataFrame:
    keyed = posts.where(F.col("asset").isNotNull() & F.col("created_utc").isNotNull())
    return keyed.groupBy(
        week_start(F.col("created_utc"), anchor).alias("week_start"), "asset"
    ).agg(F.count("*").alias("posts"))


def metric_by_model_and_asset(
    metrics: DataFrame,
    assets: Sequence[str],
    metric: str = "balanced_accuracy",
    models: Sequence[str] = MODEL_ORDER,
) -> DataFrame:
    """Models down, assets across; rows in the given model order."""
    position = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    return (
        metrics.where(F.col("model").isin(*models))
        .groupBy("model")
        .pivot("asset", list(assets))
        .agg(F.first(metric))
        .orderBy(position)
    )


def truth_and_prediction(predictions: DataFrame) -> DataFrame:
    """(model, asset, week_start, series, value): labels and predictions as two series."""
    return predictions.select(
        "model", "asset", "week_start",
        F.col("target_up").cast("int").alias("target_up"), F.col("y_pred").cast("int").alias("y_pred"),
    ).unpivot(["model", "asset", "week_start"], ["target_up", "y_pred"], "series", "value")


def latest_predictions(predictions: DataFrame, n: int = 40) -> DataFrame:
    """The last rows per (model, asset), with the direction in words."""
    return latest_rows(predictions, ["model", "asset"], n).withColumn(
        "direction", F.when(F.col("y_pred") == 1, "up").otherwise("down")
    )


def unique_predictions(predictions: DataFrame) -> DataFrame:
    return first_per_key(predictions, ["week_start", "asset", "model"], [F.col("y_pred")])


def save_report_tables(
    posts: DataFrame, panel: DataFrame, predictions: DataFrame, folder: str, settings: StudySettings = StudySettings()
) -> None:
    """Write every report table; the small metric table is kept while several are made from it."""
    once = unique_predictions(predictions)
    metrics = metrics_by_asset(once).persist()
    assets = sorted(r["asset"] for r in metrics.select("asset").distinct().collect())
    validation = settings.validation
    tables = {
        "metrics_test_by_asset": metrics.orderBy("model", "asset"),
        "confusion_percentages": confusion_shares(metrics).orderBy("model", "asset"),
        "balanced_accuracy_by_model_and_asset": metric_by_model_and_asset(metrics, assets),
        "coverage_summary": coverage_summary(posts, panel).orderBy("asset"),
        "weekly_post_volume": weekly_post_volume(posts, settings.week_anchor).orderBy("week_start", "asset"),
        "fold_timeline": fold_timeline(
            panel, validation.train_min_weeks, validation.val_weeks, validation.step_weeks, validation.test_weeks
        ).orderBy("start_week", "block"),
        "predictions_test": once.orderBy("week_start", "asset", "model"),
        "latest_predictions": latest_predictions(once).orderBy("model", "asset", "week_start"),
    }
    try:
        for name, rows in tables.items():
            save_table(rows, f"{folder}/{name}.csv")
    finally:
        metrics.unpersist()
