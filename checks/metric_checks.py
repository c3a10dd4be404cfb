"""Confusion counts, exact AUC, metric tables, folds and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.market_checks import market_panel
from checks.stand_ins import METRIC_COLUMNS, PREDICTIONS, WEEKLY, dated, metrics_sql, num, predictions, rounded, table
from tidemark.operators import folds as FO
from tidemark.operators import metrics as ME
from tidemark.operators.estimators import naive_predictions
from tidemark.operators.top_rows import best_per_group, first_per_key

FOLDS = {"train_min_weeks": 100, "val_weeks": 20, "step_weeks": 15}


def confusion_metrics(spark, folder):
    counts = ME.confusion_counts(predictions(spark, folder), ["model"])
    return rounded(ME.confusion_shares(ME.class_metrics(counts)))


CONFUSION = f"""WITH {PREDICTIONS}, {metrics_sql('predictions', 'model')}
SELECT model, tn, fp, fn, tp, n_obs, {', '.join(num(m, m) for m in ('accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1'))},
  {', '.join(num(f'{c} * 100.0::DOUBLE / (tn + fp + fn + tp)', f'{c}_pct') for c in ('tn', 'fp', 'fn', 'tp'))}
FROM metrics"""


def roc_auc(spark, folder):
    return rounded(ME.roc_auc(predictions(spark, folder), ["model", "asset"]))


def auc_with_nan(spark, folder):
    """A NaN score is no score: such rows rank nowhere."""
    found = predictions(spark, folder)
    lost = F.dayofmonth("week_start") % 3 == 0
    return rounded(ME.roc_auc(found.withColumn("y_score", F.when(lost, F.lit(float("nan"))).otherwise(F.col("y_score"))), ["model", "asset"]))


def lineitem_auc(spark, folder):
    """Late shipping against price: many distinct scores per group."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_quantity") > 25).cast("int").alias("target_up"),
        F.col("l_extendedprice").cast("double").alias("y_score"),
    )
    return rounded(ME.roc_auc(items, ["model"]))


LINEITEM_AUC = f"""WITH items AS (
  SELECT l_returnflag AS model, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS target_up, 0 AS y_pred,
         CAST(l_extendedprice AS DOUBLE) AS y_score FROM lineitem),
{metrics_sql('items', 'model')}
SELECT model, {num('auc', 'roc_auc')} FROM area"""


def by_asset(spark, folder):
    return rounded(ME.metrics_by_asset(predictions(spark, folder)))


def dedup_predictions(spark, folder):
    once = first_per_key(predictions(spark, folder), ["week_start", "asset", "model"], [F.col("y_pred")])
    return dated(once)


def _weeks(panel):
    return FO.expanding_folds(panel, **FOLDS)


def expanding_splits(spark, folder):
    return dated(_weeks(market_panel(spark, folder)))


FOLD_ROWS = """weeks AS (
  SELECT week_start, row_number() OVER (ORDER BY week_start) AS week_no, count(*) OVER () AS total
  FROM (SELECT DISTINCT week_start FROM panel)),
fold_weeks AS (
  SELECT CAST(f + 1 AS INTEGER) AS fold_id, week_start,
         CASE WHEN week_no <= 100 + f * 15 THEN 'train' ELSE 'val' END AS role
  FROM weeks, range(0, 1000) r(f)
  WHERE 100 + f * 15 + 20 <= total AND week_no <= 100 + f * 15 + 20)"""


def fold_sizes(spark, folder):
    panel = market_panel(spark, folder)
    return FO.fold_rows(panel, _weeks(panel)).groupBy("fold_id", "role").agg(F.count("*").alias("n"))


def holdout(spark, folder):
    panel = market_panel(spark, folder)
    roles = FO.holdout_roles(panel)
    return panel.join(roles, "week_start").groupBy("asset", "role").agg(
        F.count("*").alias("n"), F.to_date(F.min("week_start")).alias("first_week")
    )


HOLDOUT = """weeks AS (
  SELECT week_start, row_number() OVER (ORDER BY week_start) AS week_no, count(*) OVER () AS total
  FROM (SELECT DISTINCT week_start FROM panel)),
roles AS (SELECT week_start, CASE WHEN week_no > total - 26 THEN 'test' ELSE 'train_val' END AS role FROM weeks)"""


def naive_cv(spark, folder):
    panel = market_panel(spark, folder)
    rows = FO.fold_rows(panel, _weeks(panel).where(F.col("role") == "val"))
    scored = rows.select(
        "fold_id", "target_up", F.col("naive_persistence_signal").alias("y_pred"),
        F.col("naive_persistence_signal").cast("double").alias("y_score"),
    )
    return rounded(ME.classification_metrics(scored, ["fold_id"]))


NAIVE_CV = f"""WITH {WEEKLY}, {FOLD_ROWS},
scored AS (
  SELECT fold_id, target_up, naive_persistence_signal AS y_pred, CAST(naive_persistence_signal AS DOUBLE) AS y_score
  FROM panel JOIN fold_weeks USING (week_start) WHERE role = 'val'),
{metrics_sql('scored', 'fold_id')}
SELECT fold_id, {METRIC_COLUMNS}, n_obs FROM metrics"""


def naive_holdout(spark, folder):
    panel = market_panel(spark, folder)
    test = panel.join(FO.holdout_roles(panel).where(F.col("role") == "test"), "week_start")
    return rounded(ME.metrics_by_asset(naive_predictions(test)))


NAIVE_HOLDOUT = f"""WITH {WEEKLY}, {HOLDOUT},
scored AS (
  SELECT 'naive_persistence' AS model, asset, target_up, naive_persistence_signal AS y_pred,
         CAST(naive_persistence_signal AS DOUBLE) AS y_score
  FROM panel JOIN roles USING (week_start) WHERE role = 'test'),
{metrics_sql('scored', 'model, asset')}
SELECT model, asset, {METRIC_COLUMNS}, n_obs FROM metrics"""


def cv_summary(spark, folder):
    per_week = predictions(spark, folder).withColumn("fold", F.year("week_start"))
    return rounded(ME.cv_summary(ME.classification_metrics(per_week, ["model", "fold"])))


CV_SUMMARY = f"""WITH {PREDICTIONS}, folds AS (SELECT *, year(week_start) AS fold FROM predictions),
{metrics_sql('folds', 'model, fold')}
SELECT model, {num('avg(balanced_accuracy)', 'cv_balanced_accuracy_mean')} FROM metrics GROUP BY model"""


def best_models(spark, folder):
    metrics = ME.metrics_by_asset(predictions(spark, folder))
    best = best_per_group(metrics, ["asset"], "balanced_accuracy", "model")
    return rounded(best.select("asset", "model", "balanced_accuracy", "f1", "roc_auc"))


BEST_MODELS = f"""WITH {PREDICTIONS}, {metrics_sql('once', 'model, asset')}
SELECT asset, model, {num('balanced_accuracy', 'balanced_accuracy')}, {num('f1', 'f1')}, {num('roc_auc', 'roc_auc')}
FROM metrics QUALIFY row_number() OVER (PARTITION BY asset ORDER BY balanced_accuracy DESC, model) = 1"""


def class_weights(spark, folder):
    return rounded(ME.class_weights(market_panel(spark, folder)))


QUERIES = {
    "confusion_metrics": confusion_metrics,
    "roc_auc": roc_auc,
    "roc_auc_nan": auc_with_nan,
    "roc_auc_many_scores": lineitem_auc,
    "metrics_by_asset": by_asset,
    "dedup_predictions": dedup_predictions,
    "expanding_splits": expanding_splits,
    "fold_sizes": fold_sizes,
    "holdout": holdout,
    "naive_cv_metrics": naive_cv,
    "naive_holdout_metrics": naive_holdout,
    "cv_summary": cv_summary,
    "best_models": best_models,
    "class_weights": class_weights,
}

ORACLES = {
    "confusion_metrics": CONFUSION,
    "roc_auc": f"""WITH {PREDICTIONS},
scored AS (SELECT * FROM predictions WHERE y_score IS NOT NULL), {metrics_sql('scored', 'model, asset')}
SELECT model, asset, {num('auc', 'roc_auc')} FROM area""",
    "roc_auc_nan": f"""WITH {PREDICTIONS},
scored AS (SELECT * FROM predictions WHERE y_score IS NOT NULL AND day(week_start) % 3 != 0), {metrics_sql('scored', 'model, asset')}
SELECT model, asset, {num('auc', 'roc_auc')} FROM area""",
    "roc_auc_many_scores": LINEITEM_AUC,
    "metrics_by_asset": f"""WITH {PREDICTIONS}, {metrics_sql('once', 'model, asset')}
SELECT model, asset, {METRIC_COLUMNS}, n_obs FROM metrics""",
    "dedup_predictions": f"WITH {PREDICTIONS} SELECT * FROM once",
    "expanding_splits": f"WITH {WEEKLY}, {FOLD_ROWS} SELECT * FROM fold_weeks",
    "fold_sizes": f"""WITH {WEEKLY}, {FOLD_ROWS}
SELECT fold_id, role, count(*) AS n FROM panel JOIN fold_weeks USING (week_start) GROUP BY ALL""",
    "holdout": f"""WITH {WEEKLY}, {HOLDOUT}
SELECT asset, role, count(*) AS n, min(week_start) AS first_week FROM panel JOIN roles USING (week_start) GROUP BY ALL""",
    "naive_cv_metrics": NAIVE_CV,
    "naive_holdout_metrics": NAIVE_HOLDOUT,
    "cv_summary": CV_SUMMARY,
    "best_models": BEST_MODELS,
    "class_weights": f"""WITH {WEEKLY}
SELECT target_up, count(*) AS n, {num('sum(count(*)) OVER () / (2.0::DOUBLE * count(*))', 'weight')} FROM panel GROUP BY target_up""",
}
