"""Validation studies at their default windows: all fits of a study in the same jobs, next to Newton's method in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.market_checks import RETURNS, OHLCV, TEXT_NUMBERS, TEXT_STATS, market_panel, weekly_text
from checks.stand_ins import CHANNELS, KEYWORDS, METRIC_COLUMNS, WEEKLY, dated, metrics_sql, num, posts, rounded
from checks.term_checks import TERMS
from tidemark.operators.fold_terms import span_vocabularies
from tidemark.operators.forest import BINS, POISSON, PRIME, ROOTS
from tidemark.operators.estimators import top_importance
from tidemark.operators.metrics import classification_metrics
from tidemark.operators.numeric_prep import numeric_columns
from tidemark.operators.panel import join_text
from tidemark.operators.terms import CELL, post_terms, shared_terms, term_tasks, text_size
from tidemark.operators.weekly_text import clean_posts, weekly_stats
from tidemark.plans.experiments import VARIANTS
from tidemark.plans.many_runs import evaluate_many, grow_trees, study_assets, study_variants
from tidemark.session import keep_table
from tidemark.settings import StudySettings, default_models

#: The default study with the models SQL can fit, and with those on text.
MARKET = replace(StudySettings(), models=tuple(m for m in default_models() if m.name == "market_logreg"))
ON_TEXT = replace(StudySettings(), models=tuple(m for m in default_models() if m.name in ("text_logreg", "hybrid_logreg", "linear_svm")))
V = StudySettings().validation


def _panel(spark, folder, drop_neutral=True):
    return join_text(market_panel(spark, folder, drop_neutral), weekly_text(spark, folder))


def _cells_and_terms(spark, folder):
    """Every text is cleaned once; the cells that hold posts, and the counts of terms that several share."""
    cleaned = keep_table(clean_posts(posts(spark, folder)).select(*CELL, "created_utc", "source_id", "clean_text"))
    return cleaned.select(*CELL).distinct(), shared_terms(post_terms(cleaned), tasks=term_tasks(text_size(cleaned)))


def _panel_and_terms(spark, folder):
    """Every text is cleaned once, for the weekly numbers and for the terms."""
    cleaned = keep_table(clean_posts(posts(spark, folder)))
    panel = join_text(market_panel(spark, folder), weekly_stats(cleaned, KEYWORDS, CHANNELS))
    return panel, keep_table(shared_terms(post_terms(cleaned), tasks=term_tasks(text_size(cleaned))))


def temporal_cv(spark, folder):
    return rounded(evaluate_many(_panel(spark, folder), MARKET).cv_folds.drop("group"))


def holdout_metrics(spark, folder):
    return rounded(evaluate_many(_panel(spark, folder), MARKET).test_metrics.drop("group"))


def fold_coefficients(spark, folder):
    """Each fit's scaled coefficients by column and its intercept (the last place)."""
    fits = evaluate_many(_panel(spark, folder), MARKET).fits
    return rounded(fits.select("fold", "n_train", "n_val", F.posexplode("parameters").alias("place", "parameter")).withColumn("place", F.col("place") + 1))


def per_asset(spark, folder):
    return rounded(study_assets(_panel(spark, folder), MARKET)[1])


def robustness(spark, folder):
    return rounded(study_variants(_panel(spark, folder, drop_neutral=False), MARKET))


def text_fits(spark, folder):
    """The text models' fits of all folds: rows, vocabulary, and the gradient that is left of each loss, rounded."""
    panel, terms = _panel_and_terms(spark, folder)
    fits = evaluate_many(panel, ON_TEXT, terms).fits
    return fits.select("model", "fold", "n_train", "n_terms", (F.round("gradient", 5) + F.lit(0.0)).alias("gradient"))


def fold_vocabulary(spark, folder):
    """The vocabularies of nested spans: all cells with posts up to the end of each quarter."""
    cells, terms = _cells_and_terms(spark, folder)
    span = F.months_between(F.trunc("week_start", "quarter"), F.lit("1994-10-01").cast("date")).cast("int") / 3
    cells = keep_table(cells.select(F.lit("all").alias("group"), *CELL, span.cast("int").alias("span")))
    last = cells.agg(F.max("span") + 1).first()[0]
    sizes = spark.createDataFrame([("all", last)], "group string, spans int")
    upto = cells.select("group", F.explode(F.sequence(F.col("span"), F.lit(last - 1))).alias("span")).groupBy("group", "span").agg(F.count("*").alias("n_train"))
    found = span_vocabularies(terms, cells, sizes, upto)
    return rounded(
        found.groupBy("span").agg(
            F.count("*").alias("n_terms"), F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.avg("idf").alias("idf_mean"),
            F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.min("cf").alias("least"),
        )
    )


FOREST = replace(StudySettings(), models=tuple(m for m in default_models() if m.name == "random_forest"))


def forest_roots(spark, folder):
    """Each tree's first split on all weeks before the holdout: column, bin and fall of impurity."""
    roots = replace(FOREST, models=(replace(FOREST.models[0], params={**FOREST.models[0].params, "max_depth": 1}),))
    forest, _, columns = grow_trees(_panel(spark, folder), roots, folds=False)
    rows = [(t.number, columns[t.feature[1]], int(t.bin[1]), float(t.gain[1]), float(t.weights[1])) for t in forest.trees]
    return rounded(spark.createDataFrame(rows, "tree int, feature string, bin int, gain double, up_weight double"))


def model_predictions(spark, folder):
    """Holdout predictions of every model that the default study enables."""
    linear = replace(StudySettings(), models=(*MARKET.models, *ON_TEXT.models))
    panel, terms = _panel_and_terms(spark, folder)
    panel = keep_table(panel)
    found = evaluate_many(panel, linear, terms, folds=False).test_predictions
    forest = grow_trees(panel, FOREST, folds=False)[1].drop("fold")
    return rounded(dated(found.unionByName(forest).drop("group")))


def importance(spark, folder):
    """The market model's coefficients on all weeks before the holdout, largest first."""
    panel = _panel(spark, folder)
    fit = evaluate_many(panel, MARKET, folds=False).fits.select(F.posexplode("parameters").alias("place", "importance"))
    names = spark.createDataFrame(list(enumerate(numeric_columns(panel))), "place int, feature string")
    return rounded(top_importance(names.join(fit, "place").select("feature", "importance"), 20))


def forest_holdout(spark, folder):
    """Holdout metrics of the default forest."""
    _, predictions, _ = grow_trees(_panel(spark, folder), FOREST, folds=False)
    return rounded(classification_metrics(predictions, ["model"]))


BOOSTED = replace(StudySettings(), models=tuple(m for m in default_models() if m.name == "boosted_trees"))


def boosted_first_round(spark, folder):
    """The first tree on all weeks before the holdout: its splits, and the values of its leaves."""
    one = replace(BOOSTED, models=(replace(BOOSTED.models[0], params={**BOOSTED.models[0].params, "n_rounds": 1}),))
    model, _, columns = grow_trees(_panel(spark, folder), one, folds=False)
    (tree,) = model.trees
    rows = [(n, columns[tree.feature[n]] if tree.feature[n] >= 0 else None, int(tree.bin[n]) if tree.feature[n] >= 0 else None, float(tree.gain[n]), float(tree.chance[n]))
            for n in range(1, len(tree.feature)) if tree.feature[n] >= 0 or tree.chance[n]]
    return rounded(spark.createDataFrame(rows, "node int, feature string, bin int, gain double, value double"))


# The numeric columns in the panel's order.
COLUMNS = [*OHLCV, *RETURNS, "naive_persistence_signal", *TEXT_NUMBERS]
SIZE = len(COLUMNS) + 1


def study_rows(threshold: float = 0.002, group: str = "'all'") -> str:
    """Labelled rows of a threshold with their numbers, from ``labelled`` and ``stats``."""
    fields = [f"CAST({'coalesce(s.' + c + ', 0)' if c in TEXT_NUMBERS else 'r.' + c} AS DOUBLE) AS {c}" for c in COLUMNS]
    return f"""SELECT {group} AS grp, r.asset, r.week_start,
  CASE WHEN future_return_h > {threshold} THEN 1 WHEN future_return_h < -{threshold} THEN 0 END AS target_up, {', '.join(fields)}
FROM labelled r LEFT JOIN stats s USING (asset, week_start) WHERE abs(future_return_h) > {threshold}"""


def fitted(test_weeks: str = str(V.test_weeks), only_holdout: bool = False, steps: int = 14) -> str:
    """From ``study``: spans of weeks, imputation and scaling per fit, Newton's steps, predictions of both models.

    Newton's step solves (Gram + 1) step = gradient by Gauss-Jordan elimination over list rows.
    """
    q = range(1, SIZE + 1)
    z = [f"z{i}" for i in q]
    cell = {(i, j): f"sum(s * p * (1 - p) * z{i} * z{j}) + {int(i == j)}" for i in q for j in q if i <= j}
    grams = ", ".join(f"{e} AS h_{i}_{j}" for (i, j), e in cell.items())
    slopes = ", ".join(f"sum(s * (p - y) * z{i}) + any_value(beta)[{i}] AS g{i}" for i in q)
    matrix = "[" + ", ".join("[" + ", ".join(f"h_{min(i, j)}_{max(i, j)}" for j in q) + f", g{i}]" for i in q) + "]"
    scaled = ", ".join(
        f"(f.{c} - t.a_{c}) / t.d_{c} AS z{i}" for i, c in enumerate(COLUMNS, start=1)
    )
    val_scaled = ", ".join(f"(coalesce(r.{c}, m.{c}) - t.a_{c}) / t.d_{c}" for c in COLUMNS)
    folds = "" if only_holdout else f"""UNION ALL
  SELECT grp, i + 1, {V.train_min_weeks} + {V.step_weeks} * i, {V.train_min_weeks} + {V.step_weeks} * i + {V.val_weeks}
  FROM ends, unnest(range((before - {V.train_min_weeks + V.val_weeks}) // {V.step_weeks} + 1)) u(i)"""
    return f"""weeks AS (SELECT grp, week_start, row_number() OVER (PARTITION BY grp ORDER BY week_start) AS no FROM (SELECT DISTINCT grp, week_start FROM study)),
ends AS (SELECT grp, max(no) AS whole, max(no) - {test_weeks} AS before FROM weeks GROUP BY grp),
spans(grp, fold, upto, val_to) AS (SELECT grp, 0, before, whole FROM ends {folds}),
numbered AS (SELECT study.*, no FROM study JOIN weeks USING (grp, week_start)),
train AS (SELECT fold, upto, n.* FROM numbered n JOIN spans ON spans.grp = n.grp AND no <= upto),
med AS (SELECT grp, fold, {', '.join(f'median({c}) AS {c}' for c in COLUMNS)} FROM train GROUP BY ALL),
full_rows AS (SELECT t.grp, t.fold, t.asset, t.week_start, t.target_up AS y, {', '.join(f'coalesce(t.{c}, m.{c}) AS {c}' for c in COLUMNS)}
  FROM train t JOIN med m ON m.grp = t.grp AND m.fold = t.fold),
moments AS (SELECT grp, fold, count(*) AS n_train, count(*) / (2.0::DOUBLE * sum(y)) AS up, count(*) / (2.0::DOUBLE * sum(1 - y)) AS down,
  {', '.join(f'avg({c}) AS a_{c}, CASE WHEN min({c}) = max({c}) THEN 1 ELSE stddev_pop({c}) END AS d_{c}' for c in COLUMNS)}
  FROM full_rows GROUP BY ALL),
points AS MATERIALIZED (SELECT f.grp, f.fold, f.y, CASE WHEN f.y = 1 THEN t.up ELSE t.down END AS s, {scaled}, 1.0::DOUBLE AS z{SIZE}
  FROM full_rows f JOIN moments t ON t.grp = f.grp AND t.fold = f.fold),
newton(step, grp, fold, beta) AS (
  SELECT 0, grp, fold, list_transform(range({SIZE}), lambda x: 0.0::DOUBLE) FROM moments
  UNION ALL
  SELECT step + 1, grp, fold, list_transform(list_reduce(
      list_transform(range(1, {SIZE + 1}), lambda k: [[k::DOUBLE]]),
      lambda m, e: list_transform(m, lambda row, i: CASE WHEN i = e[1][1]
        THEN list_transform(row, lambda v: v / row[e[1][1]::INT])
        ELSE list_transform(row, lambda v, j: v - row[e[1][1]::INT] / m[e[1][1]::INT][e[1][1]::INT] * m[e[1][1]::INT][j]) END),
      {matrix}), lambda row, i: beta[i] - row[{SIZE + 1}])
  FROM (SELECT step, grp, fold, any_value(beta) AS beta, {grams}, {slopes}
        FROM (SELECT n.step, n.beta, p.*, 1 / (1 + exp(-list_dot_product([{', '.join(z)}], n.beta))) AS p
              FROM newton n JOIN points p ON p.grp = n.grp AND p.fold = n.fold WHERE n.step < {steps})
        GROUP BY step, grp, fold)),
best AS (SELECT grp, fold, beta FROM newton WHERE step = {steps}),
asked AS (SELECT r.*, s.fold, s.val_to FROM numbered r JOIN spans s ON s.grp = r.grp AND r.no > s.upto AND r.no <= s.val_to),
margins AS (SELECT r.grp, r.fold, r.asset, r.week_start, r.target_up, r.naive_persistence_signal,
    list_dot_product([{val_scaled}, 1.0::DOUBLE], b.beta) AS margin
  FROM asked r JOIN med m ON m.grp = r.grp AND m.fold = r.fold JOIN moments t ON t.grp = r.grp AND t.fold = r.fold JOIN best b ON b.grp = r.grp AND b.fold = r.fold),
predicted AS (
  SELECT grp, fold, 'market_logreg' AS model, target_up, (margin > 0)::INTEGER AS y_pred, 1 / (1 + exp(-margin)) AS y_score FROM margins
  UNION ALL SELECT grp, fold, 'naive_persistence', target_up, naive_persistence_signal::INTEGER, naive_persistence_signal::DOUBLE FROM margins),
sizes AS (SELECT m.grp, m.fold, n_train, count(*) AS n_val FROM moments m JOIN asked a ON a.grp = m.grp AND a.fold = m.fold GROUP BY ALL),
{metrics_sql('predicted', 'grp, fold, model')}"""


STUDY = f"WITH RECURSIVE {WEEKLY}, {TEXT_STATS}, study AS ({study_rows()}), {fitted()}"
_BEST = "(balanced_accuracy IS NULL), -coalesce(balanced_accuracy, 0), model"
PER_ASSET = f"""WITH RECURSIVE {WEEKLY}, {TEXT_STATS}, study AS ({study_rows(group='r.asset')}), {fitted(only_holdout=True)},
top AS (SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {_BEST}) = 1),
n AS (SELECT grp, count(DISTINCT week_start) AS n_weeks, count(*) AS n_rows FROM study GROUP BY grp)
SELECT grp AS asset, model AS best_model_test, {num('balanced_accuracy', 'best_balanced_accuracy_test')}, {num('f1', 'best_f1_test')},
  {num('roc_auc', 'best_roc_auc_test')}, n_weeks, n_rows FROM top JOIN n USING (grp)"""

_ABOUT = ", ".join(f"('{v.name}', {v.neutral_threshold}::DOUBLE, {v.test_weeks})" for v in VARIANTS)
_HELD = "CASE grp " + " ".join(f"WHEN '{v.name}' THEN {v.test_weeks}" for v in VARIANTS) + " END"
_PARTS = " UNION ALL ".join(study_rows(v.neutral_threshold, f"'{v.name}'") for v in VARIANTS)
ROBUSTNESS = f"""WITH RECURSIVE {WEEKLY}, {TEXT_STATS}, study AS ({_PARTS}), {fitted(_HELD, only_holdout=True)},
about(grp, neutral_threshold, test_weeks) AS (VALUES {_ABOUT}),
n AS (SELECT grp, count(*) AS n_rows FROM study GROUP BY grp),
top AS (SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {_BEST}) = 1),
naive AS (SELECT grp, balanced_accuracy AS base FROM metrics WHERE model = 'naive_persistence')
SELECT grp AS variant, neutral_threshold, test_weeks, n_rows, model AS best_model, {num('balanced_accuracy', 'best_balanced_accuracy')},
  {num('f1', 'best_f1')}, {num('roc_auc', 'best_roc_auc')}, {num('base', 'naive_balanced_accuracy')}, {num('balanced_accuracy - base', 'delta_vs_naive')}
FROM top JOIN about USING (grp) JOIN n USING (grp) JOIN naive USING (grp)"""

# Each span counted by itself: no prefix sums here.
FOLD_VOCABULARY = f"""WITH {TERMS},
placed AS (SELECT asset, week_start, datediff('quarter', DATE '1994-10-01', week_start) AS span FROM texts),
asked AS (SELECT DISTINCT o.span FROM placed p, (SELECT unnest(range((SELECT min(span) FROM placed), (SELECT max(span) FROM placed) + 1)) AS span) o),
every_span AS (
  SELECT a.span, t.term, count(*) AS df, sum(t.n) AS cf FROM asked a JOIN placed p ON p.span <= a.span JOIN terms t USING (asset, week_start)
  GROUP BY a.span, t.term HAVING count(*) >= 2
  QUALIFY row_number() OVER (PARTITION BY a.span ORDER BY sum(t.n) DESC, t.term) <= 8000),
held AS (SELECT a.span, count(*) AS n_train FROM asked a JOIN placed p ON p.span <= a.span GROUP BY a.span)
SELECT span::INTEGER AS span, count(*) AS n_terms, sum(df)::BIGINT AS df, sum(cf)::BIGINT AS cf, {num('avg(ln((n_train + 1.0) / (df + 1.0)) + 1.0)', 'idf_mean')},
  min(term) AS first_term, max(term) AS last_term, min(cf)::BIGINT AS least
FROM every_span JOIN held USING (span) GROUP BY span"""

# The vocabulary of each span counted by itself, and no gradient left.
TEXT_FITS = f"""WITH {WEEKLY}, {TERMS},
weeks AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS no FROM (SELECT DISTINCT week_start FROM panel)),
ends AS (SELECT max(no) - {V.test_weeks} AS before FROM weeks),
spans(fold, upto) AS (SELECT 0, before FROM ends UNION ALL SELECT i + 1, {V.train_min_weeks} + {V.step_weeks} * i
  FROM ends, unnest(range((before - {V.train_min_weeks + V.val_weeks}) // {V.step_weeks} + 1)) u(i)),
train AS (SELECT fold, p.asset, p.week_start FROM panel p JOIN weeks USING (week_start) JOIN spans ON no <= upto),
n AS (SELECT fold, count(*) AS n_train FROM train GROUP BY fold),
found AS (SELECT fold, term FROM train JOIN terms USING (asset, week_start) GROUP BY fold, term HAVING count(*) >= 2),
v AS (SELECT fold, least(count(*), 8000) AS n_terms FROM found GROUP BY fold)
SELECT model, fold::INTEGER AS fold, n_train, coalesce(n_terms, 0) AS n_terms, 0.0::DOUBLE AS gradient
FROM n LEFT JOIN v USING (fold), (VALUES ('text_logreg'), ('hybrid_logreg'), ('linear_svm')) m(model)"""

# Draws, bins and gains of the roots: each tree's counts by its two factors, five columns by their order.
_TREES = FOREST.models[0].params["n_trees"]
_DRAWN = 5
_POISSON = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in POISSON.tolist())
_TRAINED = f"""WITH RECURSIVE {WEEKLY}, {TEXT_STATS}, study AS ({study_rows()}),
weeks AS (SELECT week_start, row_number() OVER (ORDER BY week_start DESC) AS no FROM (SELECT DISTINCT week_start FROM study)),
rows_in AS (SELECT study.*, ('0x' || substr(md5(asset || '|' || epoch_us(week_start::TIMESTAMP)), 1, 8))::BIGINT % {PRIME} AS key
  FROM study JOIN weeks USING (week_start) WHERE no > {V.test_weeks})"""
_LONG = " UNION ALL ".join(f"SELECT key, target_up, {i} AS f, '{c}' AS feature, {c} AS x FROM rows_in" for i, c in enumerate(COLUMNS, start=1))
FOREST_ROOTS = f"""{_TRAINED},
long AS ({_LONG}),
q AS (SELECT f, median(x) AS m, quantile_cont(x, [{', '.join(f'{i}/{BINS}::DOUBLE' for i in range(1, BINS))}]) AS edges FROM long GROUP BY f),
binned AS (SELECT key, target_up, long.f, feature, len(list_filter(edges, lambda e: e < coalesce(x, m))) AS bin FROM long JOIN q USING (f)),
trees(t, a, b) AS (SELECT 0, {ROOTS[0]}::BIGINT, {ROOTS[1]}::BIGINT UNION ALL SELECT t + 1, a * {ROOTS[0]} % {PRIME}, b * {ROOTS[1]} % {PRIME} FROM trees WHERE t + 1 < {_TREES}),
drawn AS (SELECT t, i AS f FROM trees, unnest(range(1, {SIZE})) r(i)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY (i * a + b) % {PRIME} * {ROOTS[0]} % {PRIME}, i) <= {_DRAWN}),
boot AS (SELECT t, key, target_up, {_POISSON} AS n FROM (SELECT t, key, target_up, ((key * a + b) % {PRIME}) / {PRIME}::DOUBLE AS u FROM rows_in, trees)),
w AS (SELECT t, sum(n) / (2.0::DOUBLE * sum(n * (1 - target_up))) AS w0, sum(n) / (2.0::DOUBLE * sum(n * target_up)) AS w1 FROM boot GROUP BY t),
h AS (SELECT t, f, feature, bin, sum(n * (1 - x.target_up)) AS d, sum(n * x.target_up) AS u, count(*) AS c
  FROM drawn JOIN binned x USING (f) JOIN boot USING (t, key) WHERE n > 0 GROUP BY ALL),
s AS (SELECT t, f, feature, bin, w0, w1, sum(d) OVER o * w0 AS ld, sum(u) OVER o * w1 AS lu, sum(c) OVER o AS lc,
    sum(d) OVER p * w0 AS td, sum(u) OVER p * w1 AS tu, sum(c) OVER p AS tc
  FROM h JOIN w USING (t) WINDOW p AS (PARTITION BY t, f), o AS (PARTITION BY t, f ORDER BY bin)),
g AS (SELECT *, round((ld * ld + lu * lu) / (ld + lu) + ((td - ld) ** 2 + (tu - lu) ** 2) / (td - ld + tu - lu) - (td * td + tu * tu) / (td + tu), 9) AS gain
  FROM s WHERE lc >= 8 AND tc - lc >= 8)
SELECT t::INTEGER AS tree, feature, bin::INTEGER AS bin, {num('gain', 'gain')}, {num('w1', 'up_weight')} FROM g WHERE gain > 0
QUALIFY row_number() OVER (PARTITION BY t ORDER BY gain DESC, f, bin) = 1"""

# The first boosted tree level by level: every row has gradient 1/2 - y and hessian 1/4.
_COUNT = int(0.8 * (SIZE - 1))


def _level(d: int) -> str:
    return f"""h{d} AS (SELECT node, f, feature, bin, sum(0.5::DOUBLE - y) AS g, count(*) / 4.0::DOUBLE AS h FROM at{d} JOIN used USING (key) WHERE node >= {1 << d} GROUP BY ALL),
s{d} AS (SELECT node, f, feature, bin, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(g) OVER p AS tg, sum(h) OVER p AS th
  FROM h{d} WINDOW p AS (PARTITION BY node, f), o AS (PARTITION BY node, f ORDER BY bin)),
b{d} AS (SELECT node, f, feature, bin, gain FROM (SELECT *, round((lg * lg / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg * tg / (th + 1)) / 2, 9) AS gain
  FROM s{d} WHERE lh >= 1 AND th - lh >= 1) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1),
at{d + 1} AS (SELECT a.key, a.y, CASE WHEN b.node IS NULL THEN a.node ELSE 2 * a.node + (x.bin > b.bin)::INT END AS node
  FROM at{d} a LEFT JOIN b{d} b ON b.node = a.node LEFT JOIN used x ON x.key = a.key AND x.f = b.f)"""


BOOSTED_FIRST = f"""{_TRAINED},
long AS ({_LONG}),
q AS (SELECT f, median(x) AS m, quantile_cont(x, [{', '.join(f'{i}/{BINS}::DOUBLE' for i in range(1, BINS))}]) AS edges FROM long GROUP BY f),
chosen AS (SELECT i AS f FROM unnest(range(1, {SIZE})) r(i) ORDER BY i * {ROOTS[0]} % {PRIME} * {ROOTS[0]} % {PRIME}, i LIMIT {_COUNT}),
used AS (SELECT key, f, feature, len(list_filter(edges, lambda e: e < coalesce(x, m))) AS bin FROM long JOIN q USING (f) JOIN chosen USING (f)),
at0 AS (SELECT key, target_up AS y, 1 AS node FROM rows_in WHERE (key * {ROOTS[0]} + {ROOTS[1]}) % {PRIME} < 0.8::DOUBLE * {PRIME}),
{', '.join(_level(d) for d in range(4))},
splits AS ({' UNION ALL '.join(f'SELECT * FROM b{d}' for d in range(4))}),
leaves AS (SELECT node, -0.05::DOUBLE * sum(0.5::DOUBLE - y) / (count(*) / 4.0::DOUBLE + 1) AS value FROM at4 GROUP BY node)
SELECT node::INTEGER AS node, feature, bin::INTEGER AS bin, {num('gain', 'gain')}, 0.0::DOUBLE AS value FROM splits
UNION ALL SELECT node::INTEGER, NULL, NULL, 0.0, {num('value', 'value')} FROM leaves WHERE value <> 0"""

QUERIES = {
    "temporal_cv": temporal_cv,
    "holdout_metrics": holdout_metrics,
    "fold_coefficients": fold_coefficients,
    "per_asset_summary": per_asset,
    "robustness_summary": robustness,
    "text_fits": text_fits,
    "fold_vocabulary": fold_vocabulary,
    "model_predictions": model_predictions,
    "feature_importance": importance,
    "forest_roots": forest_roots,
    "forest_holdout": forest_holdout,
    "boosted_first_round": boosted_first_round,
}
ORACLES = {
    "temporal_cv": f"{STUDY} SELECT {METRIC_COLUMNS}, model, fold::INTEGER AS fold, n_train, n_val FROM metrics JOIN sizes USING (grp, fold) WHERE fold > 0",
    "holdout_metrics": f"WITH RECURSIVE {WEEKLY}, {TEXT_STATS}, study AS ({study_rows()}), {fitted(only_holdout=True)} SELECT model, {METRIC_COLUMNS} FROM metrics",
    "fold_coefficients": f"""{STUDY}
SELECT fold::INTEGER AS fold, n_train, n_val, i::INTEGER AS place, {num('beta[i]', 'parameter')} FROM best JOIN sizes USING (grp, fold), unnest(range(1, {SIZE + 1})) u(i)""",
    "per_asset_summary": PER_ASSET,
    "robustness_summary": ROBUSTNESS,
    "text_fits": TEXT_FITS,
    "fold_vocabulary": FOLD_VOCABULARY,
    "feature_importance": f"""WITH RECURSIVE {WEEKLY}, {TEXT_STATS}, study AS ({study_rows()}), {fitted(only_holdout=True)}
SELECT [{', '.join(f"'{c}'" for c in COLUMNS)}][i] AS feature, {num('beta[i]', 'importance')}, {num('abs(beta[i])', 'abs_importance')}
FROM best, unnest(range(1, {SIZE})) u(i) ORDER BY abs(beta[i]) DESC, feature LIMIT 20""",
    "forest_roots": FOREST_ROOTS,
    "boosted_first_round": BOOSTED_FIRST,
}
