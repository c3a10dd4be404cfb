from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.jobs import main
from tidemark.settings import StudySettings, study_settings

SETTINGS = {
    "posts": {"min_text_length": 1},
    "text": {"keyword_lexicon": ["up"], "max_features": 20},
    "validation": {"train_min_weeks": 20, "val_weeks": 6, "step_weeks": 90, "test_weeks": 8},
    "models": {"hybrid_logreg": {"enabled": True, "C": 1.0, "max_iter": 10}, "random_forest": {"n_trees": 5}},
}


def test_settings_from_a_mapping():
    settings = study_settings(SETTINGS)
    assert settings.text.keyword_lexicon == ("up",) and settings.text.min_df == 2
    assert [(m.name, m.enabled) for m in settings.models] == [("hybrid_logreg", True), ("random_forest", False)]
    assert settings.models[0].params == {"C": 1.0, "max_iter": 10}
    assert study_settings({}) == StudySettings()
    with pytest.raises(ValueError):
        study_settings({"text": {"max_feature": 1}})


def test_a_study_from_landed_tables_to_reports(spark, tmp_path):
    rng = np.random.default_rng(1)
    posts, bars = [], []
    for asset in ("A", "B"):
        close = 100.0
        for day in range(7 * 48):
            date = datetime(2023, 1, 2) + timedelta(days=day)
            close *= float(np.exp(rng.normal(0, 0.02)))
            bars.append((date, asset, asset, close, close, close, close, 1.0))
            words = "going up now" if rng.random() < 0.5 else "going down now"
            posts.append((asset, "ch", "submission", f"{asset}{day}", date, "u", 1, 1, words, "k"))
    from tidemark.schemas import BARS, POSTS

    spark.createDataFrame(posts, POSTS).write.parquet(str(tmp_path / "posts.parquet"))
    spark.createDataFrame(bars, BARS).write.csv(str(tmp_path / "bars.csv"), header=True)
    (tmp_path / "settings.json").write_text(json.dumps(SETTINGS))
    common = ["--settings", str(tmp_path / "settings.json"), "--posts", str(tmp_path / "posts.parquet"),
              "--bars", str(tmp_path / "bars.csv"), "--panel", str(tmp_path / "panel")]
    main(["panel", *common, "--out", str(tmp_path / "panel")], spark)
    main(["train", *common, "--out", str(tmp_path / "out")], spark)
    main(["report", *common, "--out", str(tmp_path / "out")], spark)
    metrics = str(tmp_path / "out" / "reports" / "metrics_test.csv")
    main(["compare", "--metrics", f"one={metrics}", f"two={metrics}", "--out", str(tmp_path / "out")], spark)

    def table(name):
        return spark.read.csv(str(tmp_path / "out" / "reports" / name), header=True)

    assert {r["model"] for r in table("metrics_test.csv").collect()} == {"naive_persistence", "hybrid_logreg"}
    assert table("final/coverage_summary.csv").count() == 2
    assert table("final/metrics_test_by_asset.csv").count() == 4
    assert table("sentiment_comparison.csv").count() == 2
    finals = {n: table(f"final/{n}.csv") for n in (
        "confusion_percentages", "balanced_accuracy_by_model_and_asset", "weekly_post_volume", "fold_timeline",
        "predictions_test", "latest_predictions",
    )}
    for r in finals["confusion_percentages"].collect():
        assert sum(float(r[f"{c}_pct"]) for c in ("tn", "fp", "fn", "tp")) == pytest.approx(100.0)
    assert finals["balanced_accuracy_by_model_and_asset"].columns == ["model", "A", "B"]
    assert sum(int(r["posts"]) for r in finals["weekly_post_volume"].collect()) == 2 * 7 * 48
    assert {"train_val", "test"} <= {r["block"] for r in finals["fold_timeline"].collect()}
    assert {r["direction"] for r in finals["latest_predictions"].collect()} <= {"up", "down"}
    every = spark.read.parquet(str(tmp_path / "panel" / "weekly_panel_all.parquet"))
    kept = spark.read.parquet(str(tmp_path / "panel" / "weekly_panel.parquet"))
    assert every.where("target_up is not null").count() == kept.count() < every.count()


def test_landing_steps(spark, tmp_path):
    values = {
        "assets": {"007": {"channels": ["ch"], "keywords": ["moon"], "ticker": "JB"}},
        "start": "2023-01-01", "end": "2023-03-01", "posts": {"max_posts_per_query": 2},
    }
    (tmp_path / "s.json").write_text(json.dumps(values))
    posts = [{"id": f"p{i}", "channel": "ch", "created_utc": 1672617600.5 + 60 * i, "title": "To the MOON" if i else "no", "body": "", "author": "u"} for i in range(4)]
    (tmp_path / "raw.json").write_text("\n".join(map(json.dumps, posts)))
    (tmp_path / "k.json").write_text("\n".join(json.dumps({"bar": ["1672617600000", "1", "2", "0.5", "1.5", "9"]}) for _ in range(2)))
    (tmp_path / "c.csv").write_text("date,close\n2023-01-02,3.5\n2023-01-03,.\n2023-03-02,4\n")
    common = ["--settings", str(tmp_path / "s.json"), "--out", str(tmp_path / "out")]
    main(["land-posts", "--raw", str(tmp_path / "raw.json"), *common], spark)
    main(["land-bars", "--series", f"007={tmp_path / 'k.json'}", f"X={tmp_path / 'c.csv'}", *common], spark)
    found = spark.read.parquet(str(tmp_path / "out" / "posts.parquet")).collect()
    assert sorted((r["source_id"], r["asset"], r["created_utc"].microsecond) for r in found) == [("p1", "007", 500000), ("p2", "007", 500000)]
    bars = spark.read.parquet(str(tmp_path / "out" / "bars.parquet")).collect()
    assert sorted((r["asset"], r["ticker"], r["close"]) for r in bars) == [("007", "JB", 1.5), ("007", "JB", 1.5), ("X", "X", 3.5)]
