"""Temporal validation, final fit and holdout evaluation of the weekly classifiers."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.estimators import (
    NAIVE,
    Features,
    TrainedModel,
    enabled_models,
    estimator,
    feature_importance,
    features_column,
    fit_features,
    naive_predictions,
    uses,
    with_class_weights,
)
from tidemark.operators.folds import fold_list, holdout_start
from tidemark.operators.metrics import METRICS, COUNTS, classification_metrics, cv_summary, metrics_by_asset
from tidemark.operators.numeric_prep import numeric_columns
from tidemark.operators.terms import text_terms
from tidemark.session import cut_lineage, use_utc
from tidemark.settings import ModelSettings, StudySettings, TextSettings
from tidemark.sources.files import save_table


ROWS_PER_TASK = 50_000


@dataclass(frozen=True)
class TrainingResult:
    cv_folds: DataFrame
    cv_summary: DataFrame
    test_metrics: DataFrame
    test_metrics_by_asset: DataFrame
    test_predictions: DataFrame
    best_model: str
    numeric_columns: list[str]
    test_start: str
    trained: dict[str, TrainedModel]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def fit_models(
    train: DataFrame,
    terms: DataFrame | None,
    models: Sequence[ModelSettings],
    columns: Sequence[str],
    settings: TextSettings = TextSettings(),
) -> list[TrainedModel]:
    """Fit every model on one training block. The feature steps are fitted once and shared."""
    fitted = [m for m in models if m.name != NAIVE]
    if not fitted:
        return []
    weighted, n_train = with_class_weights(train)
    features: Features = fit_features(train, terms, fitted, columns, n_train, settings)
    # Solvers run a job per iteration: as many tasks as the rows need, not as the panel had.
    rows = features.transform(weighted, terms).coalesce(math.ceil(n_train / ROWS_PER_TASK)).persist()
    try:
        return [
            TrainedModel(m.name, estimator(m, n_train, features_column(m.name)).fit(rows), features)
            for m in fitted
        ]
    finally:
        rows.unpersist()


def predict_block(
    block: DataFrame, terms: DataFrame | None, trained: Sequence[TrainedModel]
) -> DataFrame:
    """Baseline and model predictions for one block of weeks, in long form."""
    parts = [naive_predictions(block)] + [t.predict(block, terms) for t in trained]
    return _union(parts)


def cross_validate(
    panel: DataFrame,
    terms: DataFrame | None,
    models: Sequence[ModelSettings],
    columns: Sequence[str],
    settings: StudySettings,
    week_rows: dict,
    parallel_folds: int = 4,
) -> DataFrame:
    """Metrics per (model, fold). Folds are fitted side by side; one job computes all metrics.

    Each fold's predictions are checkpointed, so that later steps neither refit nor carry
    the plans of all folds.
    """
    v = settings.validation
    weeks = sorted(week_rows)
    folds = fold_list(weeks, v.train_min_weeks, v.val_weeks, v.step_weeks)
    if not folds:
        raise ValueError("the validation windows leave no fold; check the week settings")

    def run(fold):
        trained = fit_models(fold.train(panel), terms, models, columns, settings.text)
        predicted = predict_block(fold.validation(panel), terms, trained)
        return cut_lineage(predicted.withColumn("fold", F.lit(fold.fold_id)))

    spark = panel.sparkSession
    with ThreadPool(max(1, min(parallel_folds, len(folds)))) as pool:
        predictions = _union(pool.map(inheritable_thread_target(spark)(run), folds))
    sizes = spark.createDataFrame(
        [
            (f.fold_id, sum(n for w, n in week_rows.items() if w < f.val_start),
             sum(n for w, n in week_rows.items() if f.val_start <= w <= f.val_end))
            for f in folds
        ],
        "fold int, n_train long, n_val long",
    )
    metrics = classification_metrics(predictions, ["model", "fold"]).drop("n_obs")
    return metrics.join(sizes, "fold").select(
        *METRICS, *COUNTS, "model", "fold", "n_train", "n_val"
    )


def train_and_evaluate(
    panel: DataFrame,
    settings: StudySettings = StudySettings(),
    terms: DataFrame | None = None,
    parallel_folds: int = 4,
) -> TrainingResult:
    """Expanding-window validation, refit on all weeks before the holdout, holdout metrics.

    Text models read ``terms``; a panel that carries ``weekly_text`` needs none.
    """
    spark = use_utc(panel.sparkSession)
    columns = numeric_columns(panel)
    if not columns:
        raise ValueError("the panel has no numeric column to train on")
    models = enabled_models(settings.models)
    with_text = any(uses(m.name)[0] for m in models if m.name != NAIVE)
    labelled = panel.where(F.col("target_up").isNotNull() & F.col("week_start").isNotNull())
    if with_text and terms is None:
        if "weekly_text" not in panel.columns:
            raise ValueError("text models need the weekly terms or a weekly_text column")
        terms = text_terms(labelled, settings.text.ngram_range)
    # Every fold reads the panel and the terms again: keep them, recomputable from their plans.
    labelled = labelled.drop("weekly_text").persist()
    # What the caller has cached stays cached.
    ours = with_text and not terms.storageLevel.useMemory and not terms.storageLevel.useDisk
    terms = terms.persist() if ours else terms if with_text else None
    try:
        # One entry per calendar week.
        week_rows = {
            r["week_start"]: r["n"] for r in labelled.groupBy("week_start").agg(F.count("*").alias("n")).collect()
        }
        weeks = sorted(week_rows)
        start = holdout_start(weeks, settings.validation.test_weeks)
        train_val = labelled.where(F.col("week_start") < F.lit(start))
        test = labelled.where(F.col("week_start") >= F.lit(start))

        before = {w: n for w, n in week_rows.items() if w < start}
        folds = cut_lineage(
            cross_validate(train_val, terms, models, columns, settings, before, parallel_folds)
        )
        summary = cv_summary(folds)
        best = summary.first()["model"]

        trained = fit_models(train_val, terms, models, columns, settings.text)
        predictions = cut_lineage(predict_block(test, terms, trained))
    finally:
        labelled.unpersist()
        if ours:
            terms.unpersist()
    test_metrics = classification_metrics(predictions, ["model"]).drop("n_obs").orderBy(
        F.col("balanced_accuracy").desc(), "model"
    )
    return TrainingResult(
        cv_folds=folds,
        cv_summary=summary,
        test_metrics=test_metrics,
        test_metrics_by_asset=metrics_by_asset(predictions).orderBy("model", "asset"),
        test_predictions=predictions,
        best_model=best,
        numeric_columns=columns,
        test_start=str(start),
        trained={t.name: t for t in trained},
    )


def importance_of_best(result: TrainingResult, top_n: int = 40) -> DataFrame | None:
    if result.best_model == NAIVE:
        return None
    best = result.trained[result.best_model]
    spark = result.cv_summary.sparkSession
    return feature_importance(spark, best.model, best.features.names(best.name), top_n)


def save_results(result: TrainingResult, reports: str, models: str) -> None:
    """The report tables as CSV, metadata as JSON, and the best model unless the baseline won."""
    tables = {
        "metrics_cv_folds": result.cv_folds,
        "metrics_cv_summary": result.cv_summary,
        "metrics_test": result.test_metrics,
        "metrics_test_by_asset": result.test_metrics_by_asset,
        "predictions_test": result.test_predictions,
    }
    for name, table in tables.items():
        save_table(table, f"{reports}/{name}.csv")
    if result.best_model != NAIVE:
        result.trained[result.best_model].save(f"{models}/best_model")
        importance = importance_of_best(result)
        if importance is not None:
            save_table(importance, f"{reports}/feature_importance_best_model.csv")
    metadata = {
        "best_model": result.best_model,
        "numeric_columns": result.numeric_columns,
        "test_start": result.test_start,
    }
    spark = result.cv_summary.sparkSession
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{models}/training_metadata")
