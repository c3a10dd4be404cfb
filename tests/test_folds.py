from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds as FO

MONDAYS = [datetime(2024, 1, 1) + timedelta(weeks=i) for i in range(10)]


def weeks(spark, n=10):
    return spark.createDataFrame([(a, w) for w in MONDAYS[:n] for a in ("A", "B")], "asset string, week_start timestamp")


def test_folds_grow_by_their_step(spark):
    """Three weeks to learn from, three to judge, one further each time: five folds in ten weeks."""
    roles = {}
    for r in FO.expanding_folds(weeks(spark), 3, 3, 1).collect():
        roles.setdefault((r["fold_id"], r["role"]), set()).add(r["week_start"])
    assert roles == {
        (fold, role): set(MONDAYS[:cut] if role == "train" else MONDAYS[cut : cut + 3])
        for fold, cut in enumerate(range(3, 8), start=1) for role in ("train", "val")
    }
    listed = FO.fold_list(MONDAYS, 3, 3, 1)
    assert [(f.fold_id, f.val_start, f.val_end) for f in listed] == [(k, MONDAYS[k + 2], MONDAYS[k + 4]) for k in range(1, 6)]
    panel = weeks(spark)
    for fold in listed:
        joined = FO.fold_rows(panel, FO.expanding_folds(panel, 3, 3, 1)).where(F.col("fold_id") == fold.fold_id)
        assert fold.train(panel).count() == joined.where("role = 'train'").count()
        assert fold.validation(panel).count() == joined.where("role = 'val'").count()


def test_too_few_weeks_give_no_fold(spark):
    assert FO.expanding_folds(weeks(spark, 5), 4, 2, 2).count() == 0
    assert FO.fold_list(MONDAYS[:5], 4, 2, 2) == []
    assert FO.expanding_folds(weeks(spark, 6), 4, 2, 2).select("fold_id").distinct().count() == 1


def test_holdout(spark):
    roles = {r["week_start"]: r["role"] for r in FO.holdout_roles(weeks(spark), 3).collect()}
    assert [w for w in MONDAYS if roles[w] == "test"] == MONDAYS[-3:]
    assert FO.distinct_weeks(weeks(spark)) == MONDAYS
    many = [datetime(2020, 1, 6) + timedelta(weeks=i) for i in range(37)]
    assert FO.holdout_start(many, 26) == many[11]
    with pytest.raises(ValueError):
        FO.holdout_start(many[:36], 26)


def test_timeline(spark):
    rows = {r["block"]: r for r in FO.fold_timeline(weeks(spark), 3, 2, 1, 2, zoom_weeks=2).collect()}
    assert set(rows) == {"train_val", "test", "last_fold_train", "last_fold_val"}
    assert rows["test"]["start_week"] == MONDAYS[8] and rows["train_val"]["weeks"] == 8
    assert rows["last_fold_val"]["start_week"] == MONDAYS[6] and rows["last_fold_val"]["end_week"] == MONDAYS[7]
    assert rows["last_fold_train"]["zoom_start"] == MONDAYS[4]
