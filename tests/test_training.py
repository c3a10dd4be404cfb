from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import json
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.estimators import TrainedModel, enabled_models, feature_importance, uses
from tidemark.plans import experiments as X
from tidemark.plans import reports as R
from tidemark.plans.training import importance_of_best, save_results, train_and_evaluate
from tidemark.settings import ModelSettings, StudySettings, TextSettings, ValidationSettings, default_models

MODELS = (
    ModelSettings("market_logreg", params={"C": 1.0, "max_iter": 20}),
    ModelSettings("text_logreg", params={"C": 1.0, "max_iter": 20}),
)
STUDY = StudySettings(
    validation=ValidationSettings(train_min_weeks=20, val_weeks=8, step_weeks=12, test_weeks=10),
    text=replace(TextSettings(), max_features=20),
    models=MODELS,
)


@pytest.fixture(scope="module")
def panel(spark):
    """Two assets, 50 weeks; the words and the signal column tell the label, with some noise."""
    rng = np.random.default_rng(12)
    rows = []
    for asset in ("A", "B"):
        for week in range(50):
            up = int(rng.random() < 0.5)
            told = up if rng.random() < 0.9 else 1 - up
            words = "rise rise market" if told else "fall fall market"
            rows.append((
                asset, datetime(2023, 1, 2) + timedelta(weeks=week), float(told + rng.normal(0, 0.3)),
                None if week % 9 == 0 else float(rng.normal()), 0.01 if up else -0.01, up,
                int(rng.random() < 0.5), words,
            ))
    df = spark.createDataFrame(
        rows, "asset string, week_start timestamp, signal double, noise double, future_return_h double, "
        "target_up int, naive_persistence_signal int, weekly_text string",
    )
    return df.repartition(3).persist()


@pytest.fixture(scope="module")
def result(panel):
    return train_and_evaluate(panel, STUDY, parallel_folds=2)


def test_folds_holdout_and_choice(result, panel):
    folds = result.cv_folds.collect()
    assert sorted((r["model"], r["fold"]) for r in folds) == [
        (m, f) for m in ("market_logreg", "naive_persistence", "text_logreg") for f in (1, 2)
    ]
    assert {(r["fold"], r["n_train"], r["n_val"]) for r in folds} == {(1, 40, 16), (2, 64, 16)}
    summary = result.cv_summary.collect()
    assert summary[0]["model"] == result.best_model != "naive_persistence"
    test = {r["model"]: r for r in result.test_metrics.collect()}
    assert test["market_logreg"]["balanced_accuracy"] > 0.7 and test["text_logreg"]["balanced_accuracy"] > 0.7
    assert test["text_logreg"]["roc_auc"] > 0.7
    assert sum(test["market_logreg"][c] for c in ("tn", "fp", "fn", "tp")) == 20
    by_asset = result.test_metrics_by_asset.collect()
    assert len(by_asset) == 6 and {r["n_obs"] for r in by_asset} == {10}
    assert result.numeric_columns == ["signal", "noise", "naive_persistence_signal"]
    assert result.test_start.startswith("2023-10-09")
    predictions = result.test_predictions
    assert predictions.count() == 60
    assert predictions.where((F.col("y_score") < 0) | (F.col("y_score") > 1)).count() == 0


def test_results_are_saved_and_the_model_loads(result, panel, spark, tmp_path):
    save_results(result, str(tmp_path / "reports"), str(tmp_path / "models"))
    for name in ("metrics_cv_folds", "metrics_cv_summary", "metrics_test", "metrics_test_by_asset", "predictions_test"):
        assert spark.read.csv(str(tmp_path / "reports" / f"{name}.csv"), header=True).count() > 0
    about = json.loads(spark.read.text(str(tmp_path / "models" / "training_metadata")).first()[0])
    assert about["best_model"] == result.best_model and about["numeric_columns"] == result.numeric_columns
    loaded = TrainedModel.load(spark, str(tmp_path / "models" / "best_model"))
    from tidemark.operators.terms import text_terms

    terms = text_terms(panel)
    again = loaded.predict(panel, terms)
    first = result.trained[result.best_model].predict(panel, terms)
    key = ["week_start", "asset"]
    rows = [(r["week_start"], r["asset"], r["y_pred"], round(r["y_score"], 9)) for r in again.orderBy(*key).collect()]
    assert rows == [(r["week_start"], r["asset"], r["y_pred"], round(r["y_score"], 9)) for r in first.orderBy(*key).collect()]
    top = importance_of_best(result, 3).collect()
    assert 1 <= len(top) <= 3
    assert [r["abs_importance"] for r in top] == sorted((abs(r["importance"]) for r in top), reverse=True)


def test_every_classifier_fits_and_scores(panel, spark):
    from tidemark.operators.numeric_prep import numeric_columns
    from tidemark.operators.terms import text_terms
    from tidemark.plans.training import fit_models

    models = (
        ModelSettings("hybrid_logreg", params={"C": 0.8, "max_iter": 10}),
        ModelSettings("linear_svm", params={"C": 1.0, "max_iter": 5}),
        ModelSettings("random_forest", params={"n_trees": 5, "max_depth": 3, "min_leaf": 2}),
        ModelSettings("boosted_trees", params={"n_rounds": 3, "max_depth": 2}),
    )
    terms = text_terms(panel)
    for trained in fit_models(panel, terms, models, numeric_columns(panel), STUDY.text):
        out = trained.predict(panel, terms)
        row = out.agg(F.count("*").alias("n"), F.min("y_score").alias("low"), F.max("y_score").alias("high")).first()
        assert row["n"] == 100 and 0.0 <= row["low"] < row["high"] <= 1.0, trained.name
        table = feature_importance(spark, trained.model, trained.features.names(trained.name))
        assert table is not None and table.count() > 0, trained.name
        assert out.where("y_pred = target_up").count() > 70, trained.name


def test_refusals(panel):
    with pytest.raises(ValueError, match="unknown model"):
        uses("oracle")
    with pytest.raises(ValueError, match="few"):
        train_and_evaluate(panel, replace(STUDY, validation=replace(STUDY.validation, test_weeks=45)))
    with pytest.raises(ValueError, match="fold"):
        train_and_evaluate(panel, replace(STUDY, validation=replace(STUDY.validation, train_min_weeks=60)))
    with pytest.raises(ValueError, match="numeric"):
        train_and_evaluate(panel.select("asset", "week_start", "target_up", "weekly_text"), STUDY)
    with pytest.raises(ValueError, match="terms"):
        train_and_evaluate(panel.drop("weekly_text"), STUDY)


def test_baseline_comes_first_whatever_its_flag():
    models = (ModelSettings("random_forest"), ModelSettings("naive_persistence", enabled=False), ModelSettings("linear_svm", enabled=False))
    assert [m.name for m in enabled_models(models)] == ["naive_persistence", "random_forest"]
    assert [m.name for m in enabled_models(default_models())] == [
        "naive_persistence", "market_logreg", "text_logreg", "hybrid_logreg", "linear_svm", "random_forest"
    ]


def test_per_asset_robustness_and_comparison(panel, result):
    market = replace(STUDY, models=MODELS[:1], validation=replace(STUDY.validation, step_weeks=90))
    assets = X.train_per_asset(panel.drop("weekly_text"), market)
    summary = {r["asset"]: r for r in assets.summary.collect()}
    assert set(summary) == {"A", "B"} and summary["A"]["n_weeks"] == 50 and summary["A"]["n_rows"] == 50
    assert assets.cv_summary.count() == 4 and assets.test_metrics.count() == 4
    variants = (X.Variant("base", 0.002, 10), X.Variant("longer", 0.002, 12))
    rows = {r["variant"]: r for r in X.robustness_study(panel.drop("weekly_text"), market, variants=variants).collect()}
    assert set(rows) == {"base", "longer"} and rows["longer"]["test_weeks"] == 12 and rows["base"]["n_rows"] == 100
    for r in rows.values():
        assert r["delta_vs_naive"] == pytest.approx(r["best_balanced_accuracy"] - r["naive_balanced_accuracy"])
    compared = X.compare_experiments({"one": result.test_metrics, "two": result.test_metrics}).collect()
    assert sorted(r["experiment"] for r in compared) == ["one", "two"]


def test_report_tables(result, panel, spark, tmp_path):
    posts = spark.createDataFrame(
        [("A", "p1", datetime(2023, 1, 3)), ("C", "p2", datetime(2023, 1, 9)), ("C", None, datetime(2023, 1, 10))],
        "asset string, source_id string, created_utc timestamp",
    )
    cover = {r["asset"]: r for r in R.coverage_summary(posts, panel).collect()}
    assert set(cover) == {"A", "B", "C"} and cover["B"]["posts"] is None and cover["C"]["weekly_rows"] is None
    assert cover["C"]["posts"] == 1 and cover["A"]["weekly_rows"] == 50
    volume = sorted(tuple(r) for r in R.weekly_post_volume(posts).collect())
    assert volume == [(datetime(2023, 1, 2), "A", 1), (datetime(2023, 1, 9), "C", 2)]
    wide = R.metric_by_model_and_asset(result.test_metrics_by_asset, ["A", "B"])
    assert [r["model"] for r in wide.collect()] == ["naive_persistence", "market_logreg", "text_logreg"]
    latest = R.latest_predictions(result.test_predictions, 4)
    assert latest.count() == 24 and {r["direction"] for r in latest.collect()} <= {"up", "down"}
    assert R.truth_and_prediction(result.test_predictions).count() == 120
    R.save_report_tables(posts, panel, result.test_predictions, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "coverage_summary.csv"), header=True).count() == 3
