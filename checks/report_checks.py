"""Coverage, volume, pivots, melts, latest rows and the fold timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.market_checks import market_panel
from checks.metric_checks import FOLDS
from checks.stand_ins import ASSETS, POSTS, PREDICTIONS, WEEKLY, dated, metrics_sql, num, posts, predictions, rounded
from tidemark.operators.folds import fold_timeline
from tidemark.operators.metrics import metrics_by_asset
from tidemark.plans import reports as R
from tidemark.plans.experiments import compare_experiments, panel_sizes

MODELS = ("model_2", "model_0", "model_1")
PIVOTED = {a: a.split("-")[1].split(" ")[0].lower() for a in ASSETS}


def coverage(spark, folder):
    out = R.coverage_summary(posts(spark, folder), market_panel(spark, folder))
    return rounded(dated(out, "weekly_start", "weekly_end"))


COVERAGE = f"""WITH {POSTS}, {WEEKLY},
p AS (SELECT asset, count(source_id) AS posts, min(created_utc) AS posts_start, max(created_utc) AS posts_end FROM posts GROUP BY asset),
w AS (SELECT asset, count(week_start) AS weekly_rows, min(week_start) AS weekly_start, max(week_start) AS weekly_end,
             avg(target_up) AS share FROM panel GROUP BY asset)
SELECT asset, posts, posts_start, posts_end, weekly_rows, weekly_start, weekly_end, {num('share', 'target_up_share')}
FROM p FULL OUTER JOIN w USING (asset)"""


def weekly_volume(spark, folder):
    return dated(R.weekly_post_volume(posts(spark, folder)))


def sizes(spark, folder):
    return panel_sizes(market_panel(spark, folder))


def metric_pivot(spark, folder):
    wide = R.metric_by_model_and_asset(metrics_by_asset(predictions(spark, folder)), ASSETS, models=MODELS)
    return rounded(wide.select("model", *[F.col(f"`{a}`").alias(n) for a, n in PIVOTED.items()]))


PIVOT = f"""WITH {PREDICTIONS}, {metrics_sql('once', 'model, asset')}
SELECT model, {', '.join(num(f"max(balanced_accuracy) FILTER (asset = '{a}')", n) for a, n in PIVOTED.items())}
FROM metrics GROUP BY model"""


def melt(spark, folder):
    return dated(R.truth_and_prediction(R.unique_predictions(predictions(spark, folder))))


def latest(spark, folder):
    once = R.unique_predictions(predictions(spark, folder))
    return dated(R.latest_predictions(once, 10))


def timeline(spark, folder):
    out = fold_timeline(market_panel(spark, folder), **FOLDS)
    return dated(out, "start_week", "end_week", "zoom_start")


TIMELINE = f"""WITH {WEEKLY},
weeks AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS week_no, count(*) OVER () AS total
          FROM (SELECT DISTINCT week_start FROM panel)),
roles AS (SELECT *, CASE WHEN week_no > total - 26 THEN 'test' ELSE 'train_val' END AS role FROM weeks),
last AS (SELECT max(100 + f * 15) AS cut FROM range(0, 1000) r(f), (SELECT count(*) AS n FROM roles WHERE role = 'train_val')
         WHERE 100 + f * 15 + 20 <= n),
blocks AS (
  SELECT role AS block, week_start, week_no FROM roles
  UNION ALL SELECT 'last_fold_train', week_start, week_no FROM roles, last WHERE week_no <= cut
  UNION ALL SELECT 'last_fold_val', week_start, week_no FROM roles, last WHERE week_no > cut AND week_no <= cut + 20)
SELECT block, min(week_start) AS start_week, max(week_start) AS end_week, count(*) AS weeks,
  CASE WHEN block = 'last_fold_train' THEN (SELECT week_start FROM roles, last WHERE week_no = greatest(cut - 59, 1)) END AS zoom_start
FROM blocks GROUP BY block"""


def experiments(spark, folder):
    """One experiment per asset."""
    once = R.unique_predictions(predictions(spark, folder))
    return rounded(compare_experiments({f"on {a}": metrics_by_asset(once.where(F.col("asset") == a)) for a in ASSETS}))


EXPERIMENTS = f"""WITH {PREDICTIONS}, {metrics_sql('once', 'model, asset')}
SELECT 'on ' || asset AS experiment, model AS best_model,
  {', '.join(num(m, m) for m in ('balanced_accuracy', 'f1', 'roc_auc'))}
FROM metrics QUALIFY row_number() OVER (PARTITION BY asset ORDER BY balanced_accuracy DESC, model) = 1"""


QUERIES = {
    "coverage": coverage,
    "weekly_volume": weekly_volume,
    "panel_sizes": sizes,
    "metric_pivot": metric_pivot,
    "melt_predictions": melt,
    "latest_predictions": latest,
    "fold_timeline": timeline,
    "compare_experiments": experiments,
}

ORACLES = {
    "coverage": COVERAGE,
    "weekly_volume": """WITH """ + POSTS + """
SELECT CAST(date_trunc('week', created_utc) AS DATE) AS week_start, asset, count(*) AS posts FROM posts GROUP BY ALL""",
    "panel_sizes": f"""WITH {WEEKLY}
SELECT asset, count(DISTINCT week_start) AS n_weeks, count(*) AS n_rows FROM panel GROUP BY asset""",
    "metric_pivot": PIVOT,
    "melt_predictions": f"""WITH {PREDICTIONS}
SELECT model, asset, week_start, 'target_up' AS series, target_up AS value FROM once
UNION ALL SELECT model, asset, week_start, 'y_pred', y_pred FROM once""",
    "latest_predictions": f"""WITH {PREDICTIONS}
SELECT *, CASE WHEN y_pred = 1 THEN 'up' ELSE 'down' END AS direction FROM once
QUALIFY row_number() OVER (PARTITION BY model, asset ORDER BY week_start DESC) <= 10""",
    "fold_timeline": TIMELINE,
    "compare_experiments": EXPERIMENTS,
}
