"""Temporal validation of many studies at once: one per asset, per variant, or a single one.

Every step is a job for all folds of all studies and all linear models: one count of (group, week), one pass for
imputation and scaling, one for the vocabularies, and one per step of the solver (``operators.linear_fits``).
The losses are those of the usual study: the market model's logistic loss with a penalised intercept, the
text and hybrid models' with a free one, and the squared hinge for the linear SVM, all with balanced classes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.estimators import NAIVE, enabled_models, uses
from tidemark.operators.fold_terms import span_vocabularies
from tidemark.operators.folds import fold_list, holdout_start
from tidemark.operators.boosting import boost
from tidemark.operators.forest import Forest, bin_edges, grow_forest, row_key, score_forest
from tidemark.operators.linear_fits import Design, Fit, fit_linear, numeric_design, score_linear
from tidemark.operators.metrics import COUNTS, METRICS, classification_metrics
from tidemark.operators.numeric_prep import numeric_columns
from tidemark.operators.panel import relabel
from tidemark.operators.terms import CELL
from tidemark.operators.top_rows import best_per_group
from tidemark.plans.experiments import REDUCED_FEATURES, ROBUSTNESS_MODELS, VARIANTS, Variant, best_by_asset, robustness_rows
from tidemark.session import keep_table, use_utc
from tidemark.settings import ModelSettings, StudySettings

#: The loss of each model, and whether its intercept is penalised.
LOSSES = {"market_logreg": ("logistic", True), "text_logreg": ("logistic", False), "hybrid_logreg": ("logistic", False), "linear_svm": ("squared_hinge", True)}
#: Most (group, week) counts that the driver takes.
MAX_GROUP_WEEKS = 2_000_000
#: Gradient components at which fits on numbers, and fits with text, end.
TOLERANCE, TEXT_TOLERANCE = 1e-9, 1e-6


@dataclass(frozen=True)
class ManyRuns:
    """Metrics of all folds and holdouts with the column ``group``, predictions, and the fits themselves."""

    cv_folds: DataFrame
    cv_summary: DataFrame
    test_metrics: DataFrame
    test_predictions: DataFrame
    fits: DataFrame


@dataclass(frozen=True)
class Study:
    """One group's weeks: folds as (number, training end, validation start, validation end), holdout last as fold 0."""

    group: str
    spans: list[tuple[int, int, int, int]]
    n_train: list[int]
    n_val: list[int]
    weights: np.ndarray


def _micros(week: datetime) -> int:
    return int(week.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


FAR = 1 << 62
ROWS_PER_TASK = 50_000


def _tasks(spark, rows: int) -> int:
    """Few rows carry many fits, so that they are spread over all cores; many rows are cut by their number."""
    return max(1, min(spark.sparkContext.defaultParallelism, rows // 100), rows // ROWS_PER_TASK)


def _studies(counts: Sequence, settings: StudySettings, test_weeks: Mapping[str, int], with_folds: bool) -> list[Study]:
    """Folds (or none), holdout and class weights of each group, from its (week, label, rows)."""
    by_group: dict[str, dict[datetime, list[int]]] = {}
    for r in counts:
        by_group.setdefault(r["group"], {}).setdefault(r["week_start"], [0, 0])[int(r["target_up"])] += r["n"]
    out, v = [], settings.validation
    for group in sorted(by_group):
        weeks = sorted(by_group[group])
        start = holdout_start(weeks, test_weeks.get(group, v.test_weeks))
        before = [w for w in weeks if w < start]
        folds = fold_list(before, v.train_min_weeks, v.val_weeks, v.step_weeks)
        if not folds:
            raise ValueError("the validation windows leave no fold; check the week settings")
        spans = [(f.fold_id, _micros(f.val_start), _micros(f.val_start), _micros(f.val_end) + 1) for f in folds if with_folds]
        spans.append((0, _micros(start), _micros(start), FAR))
        trained = [np.sum([n for w, n in by_group[group].items() if _micros(w) < end], axis=0) for _, end, _, _ in spans]
        if any((t == 0).any() for t in trained):
            raise ValueError("training rows hold a single class")
        scored = [int(np.sum([n for w, n in by_group[group].items() if low <= _micros(w) < high])) for _, _, low, high in spans]
        weights = np.array([t.sum() / (2.0 * t) for t in trained])
        out.append(Study(group, spans, [int(t.sum()) for t in trained], scored, weights))
    return out


def _text(rows: DataFrame, terms: DataFrame, studies: list[Study], settings: StudySettings) -> tuple[DataFrame, np.ndarray]:
    """The rows with their term counts over the joint vocabulary, and each span's term weights."""
    spark = rows.sparkSession
    ends = [(s.group, i, end, s.n_train[i]) for s in studies for i, (_, end, _, _) in enumerate(s.spans)]
    table = F.broadcast(spark.createDataFrame(ends, "group string, span int, end long, n_train long"))
    # Kept, so that its size is known and the terms are not shuffled to meet it.
    cells = keep_table(rows.join(table, "group").where(F.col("week") < F.col("end")).groupBy("group", *CELL).agg(F.min("span").alias("span")))
    sizes = spark.createDataFrame([(s.group, len(s.spans)) for s in studies], "group string, spans int")
    found = keep_table(span_vocabularies(terms, cells, F.broadcast(sizes), table.select("group", "span", "n_train"), settings.text.max_features, settings.text.min_df))
    words = [r["term"] for r in found.select("term").distinct().orderBy("term").collect()]
    index = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(words)], "term string, idx int"))
    place = {(s.group, i): at for at, (s, i) in enumerate((s, i) for s in studies for i in range(len(s.spans)))}
    idf = np.zeros((len(place), len(words)))
    for r in found.join(index, "term").groupBy("group", "span").agg(F.collect_list(F.struct("idx", "idf")).alias("all")).toLocalIterator():
        which, value = zip(*[(e["idx"], e["idf"]) for e in r["all"]])
        idf[place[r["group"], r["span"]], list(which)] = value
    sparse = terms.join(index, "term").groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("idx", F.col("n").cast("double").alias("tf")))).alias("_entries"))
    joined = rows.join(sparse.select(*CELL, F.col("_entries.idx").alias("idx"), F.col("_entries.tf").alias("tf")), list(CELL), "left")
    empty = {"idx": F.coalesce("idx", F.array().cast("array<int>")), "tf": F.coalesce("tf", F.array().cast("array<double>"))}
    return joined.withColumns(empty), idf


def _prepared(panel: DataFrame, settings: StudySettings, columns: Sequence[str], group: str | None, test_weeks: Mapping[str, int], folds: bool) -> tuple[DataFrame, int, list[Study]]:
    """The labelled rows of all groups, kept, how many there are, and each group's spans."""
    key = F.col(group).cast("string") if group else F.lit("all")
    rows = keep_table(
        panel.withColumn("group", key).where(F.col("target_up").isNotNull() & F.col("week_start").isNotNull() & F.col("group").isNotNull()).select(
            "group", "asset", "week_start", F.unix_micros("week_start").alias("week"), F.col("target_up").cast("int").alias("target_up"),
            "naive_persistence_signal", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns if c != "naive_persistence_signal"],
        ).repartition("group", "week_start")
    )
    counts = rows.groupBy("group", "week_start", "target_up").agg(F.count("*").alias("n")).limit(MAX_GROUP_WEEKS + 1).collect()
    if len(counts) > MAX_GROUP_WEEKS:
        raise ValueError(f"more than {MAX_GROUP_WEEKS} (group, week) cells: pass fewer groups at once")
    return rows, sum(r["n"] for r in counts), _studies(counts, settings, test_weeks, folds)


def _narrow(rows: DataFrame, columns: Sequence[str], *more) -> DataFrame:
    return rows.select("group", "asset", "week_start", "week", "target_up", *more, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"))


def grow_trees(
    panel: DataFrame, settings: StudySettings = StudySettings(), group: str | None = None, folds: bool = True
) -> tuple[Forest, DataFrame, list[str]]:
    """The trees of all folds and holdouts (or, without ``folds``, of the holdouts alone), their predictions, and the columns.

    The settings are those of the study's ``random_forest`` or ``boosted_trees``, whichever it has.
    """
    spark = use_utc(panel.sparkSession)
    columns = [c for c in numeric_columns(panel) if c != group]
    (model,) = [m for m in settings.models if m.name in ("random_forest", "boosted_trees")]
    rows, counts, studies = _prepared(panel, settings, columns, group, {}, folds)
    spans = [(s, i) for s in studies for i in range(len(s.spans))]
    fits = [Fit(s.group, *s.spans[i], model.name) for s, i in spans]
    table = spark.createDataFrame([(at, f.group, f.end) for at, f in enumerate(fits)], "fit int, group string, end long")
    medians, edges = bin_edges(rows, columns, table, len(fits), max(s.n_train[i] for s, i in spans))
    base = keep_table(_narrow(rows, columns, row_key("asset", "week").alias("key")).repartition(_tasks(spark, counts)))
    p = model.params
    if model.name == "boosted_trees":
        forest, scored = boost(
            base, fits, medians, edges, int(p.get("n_rounds", 400)), int(p.get("max_depth", 4)), float(p.get("learning_rate", 0.05)),
            float(p.get("row_share", 0.8)), float(p.get("column_share", 0.8)),
        )
        return forest, scored, columns
    depth = int(p.get("max_depth", 8))
    forest = grow_forest(base, fits, medians, edges, int(p.get("n_trees", 300)), depth, int(p.get("min_leaf", 8)))
    return forest, score_forest(base, forest, depth), columns


def evaluate_many(
    panel: DataFrame, settings: StudySettings = StudySettings(), terms: DataFrame | None = None, group: str | None = None,
    test_weeks: Mapping[str, int] | None = None, folds: bool = True,
) -> ManyRuns:
    """Expanding-window validation, refit and holdout of the naive and the linear models, for each value of ``group``.

    ``test_weeks`` may give groups their own holdout; without ``folds`` only the holdout's fits are made. Models other than the linear ones are refused; use
    ``plans.training``. Rows without label, week or group take no part. A group without a fold, with too few
    weeks or with a single class before a span's end raises, as a single study does.
    """
    spark = use_utc(panel.sparkSession)
    models = [m for m in enabled_models(settings.models) if m.name != NAIVE]
    unknown = [m.name for m in models if m.name not in LOSSES]
    if unknown:
        raise ValueError(f"not linear: {unknown}")
    columns = [c for c in numeric_columns(panel) if c != group]
    if not columns:
        raise ValueError("the panel has no numeric column to train on")
    with_text = [m for m in models if uses(m.name)[0]]
    if with_text and terms is None:
        raise ValueError("text models need the weekly terms")
    rows, counts, studies = _prepared(panel, settings, columns, group, test_weeks or {}, folds)
    spans = [(s, i) for s in studies for i in range(len(s.spans))]
    table = spark.createDataFrame([(at, s.group, s.spans[i][1]) for at, (s, i) in enumerate(spans)], "fit int, group string, end long")
    most = max((s.n_train[i] for s, i in spans), default=0)
    scaled = numeric_design(rows, columns, table, len(spans), most)
    weights = np.array([s.weights[i] for s, i in spans])
    narrow = _narrow(rows, columns)

    predictions, about = [], []
    for some, has_text in (([m for m in models if m not in with_text], False), (with_text, True)):
        if not some:
            continue
        base, idf = _text(narrow, terms, studies, settings) if has_text else (narrow, np.zeros((len(spans), 0)))
        base = keep_table(base.repartition(_tasks(spark, counts)))
        at = [(m, place, s, i) for m in some for place, (s, i) in enumerate(spans)]
        fits = [_fit(m, s, i) for m, _, s, i in at]
        places = [place for _, place, _, _ in at]
        design = Design(*[part[places] for part in scaled], idf[places], weights[places])
        theta, slopes = fit_linear(base, fits, design, TEXT_TOLERANCE if has_text else TOLERANCE)
        predictions.append(score_linear(base, fits, design, theta))
        names = np.count_nonzero(design.idf, axis=1)
        about += [(f.group, f.model, f.fold, s.n_train[i], s.n_val[i], int(n), float(g), theta[k, idf.shape[1] :].tolist())
                  for k, (f, (_, _, s, i), n, g) in enumerate(zip(fits, at, names, slopes))]
    blocks = F.broadcast(spark.createDataFrame([(s.group, s.spans[i][0], s.spans[i][2], s.spans[i][3], s.n_train[i], s.n_val[i]) for s, i in spans],
                                              "group string, fold int, low long, high long, n_train long, n_val long"))
    signal = F.col("naive_persistence_signal")
    naive = rows.join(blocks, "group").where((F.col("week") >= F.col("low")) & (F.col("week") < F.col("high"))).select(
        "group", "asset", "week_start", "target_up", F.lit(NAIVE).alias("model"), "fold", signal.cast("int").alias("y_pred"), signal.cast("double").alias("y_score")
    )
    for part in predictions:
        naive = naive.unionByName(part)
    predicted = keep_table(naive)
    metrics = keep_table(classification_metrics(predicted, ["group", "model", "fold"]).join(blocks.drop("low", "high"), ["group", "fold"]))
    cv = metrics.where("fold > 0").select("group", *METRICS, *COUNTS, "model", "fold", "n_train", "n_val")
    summary = cv.groupBy("group", "model").agg(F.avg("balanced_accuracy").alias("cv_balanced_accuracy_mean"))
    fits_table = spark.createDataFrame(about, "group string, model string, fold int, n_train long, n_val long, n_terms long, gradient double, parameters array<double>")
    return ManyRuns(
        cv, summary, metrics.where("fold = 0").select("group", "model", *METRICS, *COUNTS),
        predicted.where("fold = 0").drop("fold"), fits_table,
    )


def _fit(model: ModelSettings, study: Study, i: int) -> Fit:
    loss, penalised = LOSSES[model.name]
    text, numeric = uses(model.name)
    number, end, low, high = study.spans[i]
    return Fit(study.group, number, end, low, high, model.name, loss, float(model.params.get("C", 1.0)), penalised, text, numeric)


def best_cv_model(runs: ManyRuns) -> DataFrame:
    """(group, model, cv_balanced_accuracy_mean) of each group's best model."""
    return best_per_group(runs.cv_summary, ["group"], "cv_balanced_accuracy_mean", "model").select("group", "model", "cv_balanced_accuracy_mean")


def study_assets(panel: DataFrame, settings: StudySettings = StudySettings(), terms: DataFrame | None = None) -> tuple[ManyRuns, DataFrame]:
    """A study of each asset's own rows, all in the same jobs, with the summary per asset."""
    runs = evaluate_many(panel, settings, terms, "asset")
    return runs, best_by_asset(runs.test_metrics.withColumnRenamed("group", "asset"), panel.where(F.col("target_up").isNotNull()))


def study_variants(
    panel: DataFrame, settings: StudySettings = StudySettings(), terms: DataFrame | None = None, variants: Sequence[Variant] = VARIANTS
) -> DataFrame:
    """The robustness rows of all variants (threshold of neutral weeks, holdout) from the same jobs.

    ``panel`` still holds its neutral weeks. The models are the study's among those of the robustness runs.
    """
    parts = None
    for variant in variants:
        part = relabel(panel, variant.neutral_threshold).withColumn("variant", F.lit(variant.name))
        parts = part if parts is None else parts.unionByName(part)
    if len({v.name for v in variants}) < len(variants):
        raise ValueError("variants need names of their own")
    reduced = StudySettings(
        validation=settings.validation, models=tuple(m for m in settings.models if m.name in ROBUSTNESS_MODELS),
        text=type(settings.text)(**{**settings.text.__dict__, "max_features": min(settings.text.max_features, REDUCED_FEATURES)}),
    )
    parts = keep_table(parts.drop("weekly_text"))
    runs = evaluate_many(parts, reduced, terms, "variant", {v.name: v.test_weeks for v in variants})
    sizes = parts.groupBy("variant").agg(F.count("*").alias("n_rows"))
    spark = panel.sparkSession
    about = F.broadcast(spark.createDataFrame([(v.name, v.neutral_threshold, v.test_weeks) for v in variants], "variant string, neutral_threshold double, test_weeks int"))
    return robustness_rows(runs.test_metrics.withColumnRenamed("group", "variant").join(about, "variant").join(sizes, "variant"))
