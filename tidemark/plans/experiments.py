"""Studies made of several training runs: per asset, robustness variants, backend comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.estimators import NAIVE
from tidemark.operators.panel import relabel
from tidemark.operators.top_rows import best_per_group
from tidemark.plans.training import TrainingResult, save_results, train_and_evaluate
from tidemark.settings import StudySettings
from tidemark.sources.files import save_table

MAX_ASSET_RUNS = 500


@dataclass(frozen=True)
class Variant:
    name: str
    neutral_threshold: float
    test_weeks: int


# The five settings of the robustness study.
VARIANTS = (
    Variant("base", 0.002, 26),
    Variant("no_neutral_zone", 0.0, 26),
    Variant("wide_neutral_zone", 0.005, 26),
    Variant("test_20_weeks", 0.002, 20),
    Variant("test_39_weeks", 0.002, 39),
)
ROBUSTNESS_MODELS = (NAIVE, "market_logreg", "hybrid_logreg")
REDUCED_FEATURES = 2500


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@contextmanager
def _kept(*tables: DataFrame | None):
    """Cache the tables that every run of a study reads; they can be recomputed from their plans."""
    present = [t.persist() for t in tables if t is not None]
    try:
        yield
    finally:
        for table in present:
            table.unpersist()


def best_on_test(metrics: DataFrame, group: Sequence[str]) -> DataFrame:
    """The best holdout row per group, by balanced accuracy."""
    return best_per_group(metrics, group, "balanced_accuracy", "model")


def panel_sizes(panel: DataFrame, group: str = "asset") -> DataFrame:
    return panel.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_distinct("week_start").alias("n_weeks"), F.count("*").alias("n_rows")
    )


def best_by_asset(test_metrics: DataFrame, panel: DataFrame) -> DataFrame:
    """Summary row per asset, from the holdout metrics of its own runs."""
    best = best_on_test(test_metrics, ["asset"]).select(
        "asset", F.col("model").alias("best_model_test"),
        F.col("balanced_accuracy").alias("best_balanced_accuracy_test"),
        F.col("f1").alias("best_f1_test"), F.col("roc_auc").alias("best_roc_auc_test"),
    )
    return best.join(panel_sizes(panel), "asset").orderBy("asset")


@dataclass(frozen=True)
class AssetStudy:
    results: dict[str, TrainingResult]
    summary: DataFrame
    cv_summary: DataFrame
    test_metrics: DataFrame


def train_per_asset(
    panel: DataFrame, settings: StudySettings = StudySettings(), terms: DataFrame | None = None
) -> AssetStudy:
    """One full training run per asset, on that asset's rows alone."""
    with _kept(panel, terms):
        found = panel.where(F.col("asset").isNotNull()).select("asset").distinct()
        assets = sorted(r[0] for r in found.limit(MAX_ASSET_RUNS + 1).collect())
        if len(assets) > MAX_ASSET_RUNS:
            raise ValueError(f"more than {MAX_ASSET_RUNS} assets: pass a panel of the ones to train")
        results = {
            asset: train_and_evaluate(
                panel.where(F.col("asset") == asset), settings,
                None if terms is None else terms.where(F.col("asset") == asset),
            )
            for asset in assets
        }
    cv = _union([r.cv_summary.withColumn("asset", F.lit(a)) for a, r in results.items()])
    test = _union([r.test_metrics.withColumn("asset", F.lit(a)) for a, r in results.items()])
    return AssetStudy(results, best_by_asset(test, panel), cv, test)


def save_asset_study(study: AssetStudy, reports: str, models: str) -> None:
    """Every asset's own report folder, and the tables over all assets."""
    for asset, result in study.results.items():
        save_results(result, f"{reports}/{asset.lower()}", f"{models}/{asset.lower()}")
    save_table(study.summary, f"{reports}/summary_best_models.csv")
    save_table(study.cv_summary, f"{reports}/metrics_cv_summary_all_assets.csv")
    save_table(study.test_metrics, f"{reports}/metrics_test_all_assets.csv")


def hybrid_settings(settings: StudySettings) -> StudySettings:
    """The same study with both sentiment backends and the reduced vocabulary."""
    text = replace(
        settings.text, sentiment_backend="hybrid", model_batch_size=8,
        max_features=min(settings.text.max_features, REDUCED_FEATURES),
    )
    return replace(settings, text=text)


def variant_settings(settings: StudySettings, test_weeks: int) -> StudySettings:
    return replace(
        settings,
        validation=replace(settings.validation, test_weeks=test_weeks),
        text=replace(settings.text, max_features=min(settings.text.max_features, REDUCED_FEATURES)),
        models=tuple(replace(m, enabled=m.name in ROBUSTNESS_MODELS) for m in settings.models),
    )


def robustness_rows(test_metrics: DataFrame) -> DataFrame:
    """Best model, baseline and their difference per variant, in one aggregation.

    ``test_metrics`` holds the holdout metrics of all variants with their settings.
    """
    keys = ["variant", "neutral_threshold", "test_weeks", "n_rows"]
    score = F.col("balanced_accuracy")
    best_first = F.struct(score.isNull(), -F.coalesce(score, F.lit(0.0)), F.col("model"))
    rows = test_metrics.groupBy(*keys).agg(
        F.min_by(F.struct("model", "balanced_accuracy", "f1", "roc_auc"), best_first).alias("_best"),
        F.max(F.when(F.col("model") == NAIVE, score)).alias("naive_balanced_accuracy"),
    )
    return rows.select(
        *keys, F.col("_best.model").alias("best_model"),
        F.col("_best.balanced_accuracy").alias("best_balanced_accuracy"),
        F.col("_best.f1").alias("best_f1"), F.col("_best.roc_auc").alias("best_roc_auc"),
        "naive_balanced_accuracy",
        (F.col("_best.balanced_accuracy") - F.col("naive_balanced_accuracy")).alias("delta_vs_naive"),
    )


def robustness_study(
    panel: DataFrame,
    settings: StudySettings = StudySettings(),
    terms: DataFrame | None = None,
    variants: Sequence[Variant] = VARIANTS,
) -> DataFrame:
    frames = []
    with _kept(panel, terms):
        for variant in variants:
            rows = relabel(panel, variant.neutral_threshold)
            result = train_and_evaluate(rows, variant_settings(settings, variant.test_weeks), terms)
            frames.append(
                result.test_metrics.withColumns(
                    {
                        "variant": F.lit(variant.name),
                        "neutral_threshold": F.lit(variant.neutral_threshold),
                        "test_weeks": F.lit(variant.test_weeks),
                        "n_rows": F.lit(rows.count()),
                    }
                )
            )
    return robustness_rows(_union(frames))


def compare_experiments(metrics: Mapping[str, DataFrame]) -> DataFrame:
    """(experiment, best_model, balanced_accuracy, f1, roc_auc): the best row of each table."""
    tables = [m.withColumn("experiment", F.lit(name)) for name, m in metrics.items()]
    return best_on_test(_union(tables), ["experiment"]).select(
        "experiment", F.col("model").alias("best_model"), "balanced_accuracy", "f1", "roc_auc"
    )
