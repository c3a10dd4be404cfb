from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linear_fits as L
from tidemark.operators.fold_terms import span_terms, span_vocabularies
from tidemark.operators.terms import text_terms, vocabulary
from tidemark.operators.top_rows import first_rows
from tidemark.plans import experiments as X
from tidemark.plans.many_runs import best_cv_model, evaluate_many, study_assets, study_variants
from tidemark.settings import ModelSettings, StudySettings, TextSettings, ValidationSettings

WEEK = 7 * 86_400_000_000


def numbers(size=240, seed=5):
    """Rows of two groups with gaps, a constant column, a column without values in one group, and sparse counts."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(size):
        group, week = "ab"[i % 2], (i // 4) * WEEK
        x = [rng.normal(), None if i % 5 == 0 else rng.normal() * 40 + 7, 3.0, None if group == "a" else rng.normal()]
        counts = rng.integers(0, 3, 12) if i % 7 else np.zeros(12, int)
        y = int(x[0] + 0.02 * (x[1] or 0) + 0.4 * counts[0] + rng.normal() > 0.6)
        rows.append((group, f"s{i % 4}", week, y, [None if v is None else float(v) for v in x], [int(j) for j in np.flatnonzero(counts)], [float(v) for v in counts[counts > 0]]))
    return rows


SCHEMA = "group string, asset string, week long, target_up int, x array<double>, idx array<int>, tf array<double>"


def matrix(rows, design, at, fit, low, high):
    """Features of one fit in the plainest way."""
    out, labels = [], []
    for group, _, week, y, x, idx, tf in rows:
        if group != fit.group or not low <= week < high:
            continue
        filled = [design.medians[at, i] if v is None else v for i, v in enumerate(x)]
        dense = [(v - design.means[at, i]) / design.deviations[at, i] * fit.numeric for i, v in enumerate(filled)]
        text = np.zeros(design.idf.shape[1])
        for j, n in zip(idx, tf) if len(text) else ():
            text[j] = n * design.idf[at, j]
        if np.any(text):
            text /= np.linalg.norm(text)
        out.append([*(text * fit.text), *dense, 1.0])
        labels.append(y)
    return np.array(out), np.array(labels)


def slope(theta, points, y, weights, fit):
    margin = points @ theta
    s = fit.c * weights[y]
    if fit.loss == "logistic":
        first = s * (1 / (1 + np.exp(-margin)) - y)
    else:
        sign = 2 * y - 1
        first = -2 * s * sign * np.maximum(0, 1 - sign * margin)
    penalty = theta.copy()
    penalty[-1] *= fit.penalise_intercept
    return points.T @ first + penalty


def design_of(rows, fits, terms, seed=2):
    rng = np.random.default_rng(seed)
    size = len(rows[0][4])
    made = L.Design(np.zeros((len(fits), size)), np.zeros((len(fits), size)), np.ones((len(fits), size)), rng.random((len(fits), terms)) + 0.5, np.ones((len(fits), 2)))
    made.idf[0, 3:4] = 0.0
    for at, fit in enumerate(fits):
        mine = [r for r in rows if r[0] == fit.group and r[2] < fit.end]
        for i in range(size):
            known = [r[4][i] for r in mine if r[4][i] is not None]
            if known:
                made.medians[at, i] = np.median(known)
                filled = [made.medians[at, i] if r[4][i] is None else r[4][i] for r in mine]
                made.means[at, i], made.deviations[at, i] = np.mean(filled), np.std(filled) if min(filled) < max(filled) else 1.0
        y = np.array([r[3] for r in mine])
        made.weights[at] = [len(y) / (2 * (y == c).sum()) for c in (0, 1)]
    return made


FITS = [
    L.Fit(g, fold, end * WEEK, end * WEEK, (end + 9) * WEEK, loss=loss, c=c, penalise_intercept=penalised, numeric=True)
    for g in "ab" for fold, end in enumerate((20, 35, 50)) for loss, c, penalised in (("logistic", 1.0, True), ("logistic", 0.3, False), ("squared_hinge", 1.0, True))
]


def test_imputation_and_scaling_of_nested_spans(spark):
    rows = numbers()
    table = spark.createDataFrame([(r[0], r[2], *r[4]) for r in rows], "group string, week long, a double, b double, c double, d double")
    fits = FITS[::3]
    spans = spark.createDataFrame([(i, f.group, f.end) for i, f in enumerate(fits)], "fit int, group string, end long")
    expected = design_of(rows, fits, 0)
    for most in (1, 10**9):
        found = L.numeric_design(table, list("abcd"), spans, len(fits), most)
        for got, want in zip(found, (expected.medians, expected.means, expected.deviations)):
            assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("block", [L.BLOCK_NUMBERS, 120])
def test_fits_on_numbers_reach_the_minimum(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_NUMBERS", block)
    rows = numbers()
    design = design_of(rows, FITS, 0)
    theta, left = L.fit_linear(spark.createDataFrame(rows, SCHEMA).repartition(3), FITS, design)
    assert theta.shape == (len(FITS), 5) and left.max() < 1e-9
    for at, fit in enumerate(FITS):
        points, y = matrix(rows, design, at, fit, 0, fit.end)
        assert np.abs(slope(theta[at], points, y, design.weights[at], fit)).max() < 1e-8
        assert theta[at, 2] == 0.0


def test_fits_on_text_and_numbers_reach_the_minimum_and_score(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_AT_ONCE", 7)
    rows = numbers()
    kinds = [(True, False), (True, True), (False, True)]
    fits = [replace(f, text=t, numeric=n, model=f"{t}{n}{i}") for i, f in enumerate(FITS[:9]) for t, n in (kinds[i % 3],)]
    design = design_of(rows, fits, 12)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    theta, left = L.fit_linear(table, fits, design, 1e-8)
    assert left.max() < 1e-8
    for at, fit in enumerate(fits):
        points, y = matrix(rows, design, at, fit, 0, fit.end)
        assert np.abs(slope(theta[at], points, y, design.weights[at], fit)).max() < 1e-7
        assert fit.text or not theta[at, :12].any()
        assert fit.numeric or not theta[at, 12:-1].any()
    scored = {}
    for r in L.score_linear(table, fits, design, theta).collect():
        scored.setdefault((r["model"], r["fold"]), []).append((r["y_score"], r["y_pred"], r["target_up"]))
    for at, fit in enumerate(fits):
        points, y = matrix(rows, design, at, fit, fit.val_start, fit.val_end)
        expected = sorted((1 / (1 + np.exp(-m)), int(m > 0), int(v)) for m, v in zip(points @ theta[at], y))
        assert [x[1:] for x in sorted(scored[fit.model, fit.fold])] == [x[1:] for x in expected]
        assert [x[0] for x in sorted(scored[fit.model, fit.fold])] == pytest.approx([x[0] for x in expected])


def test_vocabularies_of_nested_spans_equal_counting_each(spark):
    rng = np.random.default_rng(3)
    start = datetime(2024, 1, 1)
    cells = [(a, start + timedelta(weeks=w), w) for a in "AB" for w in range(12)]
    terms = [(a, week, f"t{t}", int(rng.integers(1, 4))) for a, week, w in cells for t in set(rng.integers(0, 9 + w, 4).tolist())]
    table = spark.createDataFrame(terms, "asset string, week_start timestamp, term string, n long")
    ends = (4, 7, 12)
    first = spark.createDataFrame([(g, a, week, next(i for i, e in enumerate(ends) if w < e)) for a, week, w in cells for g in ("all", a)],
                                  "group string, asset string, week_start timestamp, span int")
    spans = spark.createDataFrame([(g, 3) for g in ("all", "A", "B")], "group string, spans int")
    grown = {}
    for r in span_terms(table, first, spans).collect():
        grown[r["group"], r["span"], r["term"]] = (r["df"], r["cf"])
    n_train = spark.createDataFrame([(g, i, e * (2 if g == "all" else 1)) for g in ("all", "A", "B") for i, e in enumerate(ends)], "group string, span int, n_train long")
    kept = {}
    for r in span_vocabularies(table, first, spans, n_train, 6).collect():
        kept.setdefault((r["group"], r["span"]), {})[r["term"]] = (r["df"], r["cf"], r["idf"])
    for group in ("all", "A", "B"):
        for span, end in enumerate(ends):
            part = table.where(F.col("week_start") < F.lit(start + timedelta(weeks=end)))
            part = part if group == "all" else part.where(F.col("asset") == group)
            own = part.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf")).where("df >= 2").collect()
            assert {k[2]: v for k, v in grown.items() if k[:2] == (group, span)} == {r["term"]: (r["df"], r["cf"]) for r in own}
            plain = {r["term"]: r["idf"] for r in vocabulary(part, end * (2 if group == "all" else 1), 6).collect()}
            assert {t: v[2] for t, v in kept[group, span].items()} == pytest.approx(plain)


@pytest.mark.parametrize("n", [1, 3, 40, 1_001, 1_500, 5_000])
def test_first_rows_of_hot_groups_equal_a_sort(spark, monkeypatch, n):
    rows = [("hot" if i % 3 else f"g{i % 40}", (i * 7919) % 97, i) for i in range(4_000)]
    table = spark.createDataFrame(rows, "key string, at long, id long").withColumn("_extra", F.lit("clash"))
    for bounds in (None, sorted({(k, a, i) for k, a, i in rows[::61]}), [("hot", 50, 0)], [("zz", 0, 0)]):
        for down in ((), ("at", "id")):
            got = first_rows(table, ["key"], ["at", "id"], n, down, bounds)
            assert got.columns == table.columns
            expected = []
            for key in {r[0] for r in rows}:
                expected += sorted((r for r in rows if r[0] == key), key=lambda r: r[1:], reverse=bool(down))[:n]
            assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(expected)
        if n <= 1_000:
            break


def test_first_rows_take_one_direction(spark):
    with pytest.raises(ValueError, match="descending"):
        first_rows(spark.createDataFrame([("a", 1, 2)], "key string, at int, id int"), ["key"], ["at", "id"], 2_000, ["at"])


# Whole studies -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    rows = []
    for asset in ("A", "B"):
        for week in range(60):
            up = int(rng.random() < 0.5)
            told = up if rng.random() < 0.85 else 1 - up
            rows.append((asset, datetime(2023, 1, 2) + timedelta(weeks=week), float(told + rng.normal(0, 0.4)), None if week % 9 == 0 else float(rng.normal()),
                         0.01 if up else -0.01, up, int(rng.random() < 0.5), "rise rise market" if told else "fall fall market"))
    return spark.createDataFrame(
        rows, "asset string, week_start timestamp, signal double, noise double, future_return_h double, target_up int, naive_persistence_signal int, weekly_text string"
    ).persist()


STUDY = StudySettings(
    validation=ValidationSettings(train_min_weeks=20, val_weeks=8, step_weeks=10, test_weeks=10), text=replace(TextSettings(), max_features=20),
    models=(ModelSettings("market_logreg"), ModelSettings("text_logreg"), ModelSettings("hybrid_logreg", params={"C": 0.8}), ModelSettings("linear_svm")),
)


def test_a_study_with_all_linear_models(panel):
    runs = evaluate_many(panel, STUDY, text_terms(panel))
    folds = runs.cv_folds.collect()
    models = ("market_logreg", "text_logreg", "hybrid_logreg", "linear_svm", "naive_persistence")
    assert sorted((r["model"], r["fold"]) for r in folds) == sorted((m, f) for m in models for f in (1, 2, 3))
    assert {(r["fold"], r["n_train"], r["n_val"]) for r in folds} == {(1, 40, 16), (2, 60, 16), (3, 80, 16)}
    test = {r["model"]: r for r in runs.test_metrics.collect()}
    assert all(test[m]["balanced_accuracy"] > 0.6 for m in models[:4]), {m: r["balanced_accuracy"] for m, r in test.items()}
    assert runs.test_predictions.count() == 5 * 20
    fits = runs.fits.collect()
    assert all(r["gradient"] < 1e-6 for r in fits) and {r["n_terms"] for r in fits if r["model"] == "text_logreg"} == {7}
    assert best_cv_model(runs).first()["model"] in models[:4]


def test_assets_and_variants_in_the_same_jobs_equal_single_studies(panel):
    market = replace(STUDY, models=STUDY.models[:1])
    runs, summary = study_assets(panel.drop("weekly_text"), market)
    for asset in ("A", "B"):
        alone = evaluate_many(panel.drop("weekly_text").where(F.col("asset") == asset), market)
        mine = {r["fold"]: r["parameters"] for r in runs.fits.where(F.col("group") == asset).collect()}
        for r in alone.fits.collect():
            assert mine[r["fold"]] == pytest.approx(r["parameters"], abs=1e-8)
    assert {r["asset"]: (r["n_weeks"], r["n_rows"]) for r in summary.collect()} == {"A": (60, 60), "B": (60, 60)}
    variants = (X.Variant("base", 0.002, 10), X.Variant("longer", 0.0, 14))
    rows = {r["variant"]: r for r in study_variants(panel, market, variants=variants).collect()}
    assert set(rows) == {"base", "longer"} and rows["longer"]["test_weeks"] == 14 and rows["base"]["n_rows"] == 120
    assert rows["base"]["delta_vs_naive"] == pytest.approx(rows["base"]["best_balanced_accuracy"] - rows["base"]["naive_balanced_accuracy"])


def test_refusals(panel):
    with pytest.raises(ValueError, match="linear"):
        evaluate_many(panel, replace(STUDY, models=(ModelSettings("random_forest"),)))
    with pytest.raises(ValueError, match="terms"):
        evaluate_many(panel, STUDY)
    with pytest.raises(ValueError, match="fold"):
        evaluate_many(panel, replace(STUDY, models=STUDY.models[:1], validation=replace(STUDY.validation, train_min_weeks=55)))
    with pytest.raises(ValueError, match="numeric"):
        evaluate_many(panel.select("asset", "week_start", "target_up"), replace(STUDY, models=STUDY.models[:1]))
    with pytest.raises(ValueError, match="single class"):
        evaluate_many(panel.withColumn("target_up", F.lit(1)), replace(STUDY, models=STUDY.models[:1]))
    with pytest.raises(ValueError, match="names"):
        study_variants(panel, STUDY, variants=(X.VARIANTS[0], X.VARIANTS[0]))


def test_spans_vocabularies_meet_no_shuffle_by_group_and_settle_ties_by_the_term(spark):
    rows = [("a", w, f"t{i:02d}", 1 + (i + w) % 3) for w in range(6) for i in range(12) if (i * w) % 5 != 3]
    table = spark.createDataFrame(rows, "asset string, week_start int, term string, n long")
    cells = spark.createDataFrame([("all", "a", w, w // 2) for w in range(6)], "group string, asset string, week_start int, span int")
    spans = spark.createDataFrame([("all", 3)], "group string, spans int")
    n_train = spark.createDataFrame([("all", s, 2 * s + 2) for s in range(3)], "group string, span int, n_train int")
    plan = span_terms(table, cells, spans)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [group#" in plan
    for most in (1, 4, 7, 100):
        expected = set()
        for span in range(3):
            seen = [r for r in rows if r[1] // 2 <= span]
            total = {t: (sum(r[2] == t for r in seen), sum(r[3] for r in seen if r[2] == t)) for t in {r[2] for r in seen}}
            kept = sorted((t for t in total if total[t][0] >= 2), key=lambda t: (-total[t][1], t))[:most]
            expected |= {(span, t, *total[t]) for t in kept}
        found = span_vocabularies(table, cells, spans, n_train, most).collect()
        assert len(found) == len(expected) and {(r["span"], r["term"], r["df"], r["cf"]) for r in found} == expected


def test_text_sums_of_all_fits_come_from_one_matrix_of_counts():
    rng = np.random.default_rng(5)
    n, terms = 9, 6
    counts = rng.integers(0, 3, (n, terms)) * (rng.random((n, terms)) < 0.5)
    counts[4] = 0
    idx = [np.flatnonzero(c).tolist() for c in counts]
    batch = pa.RecordBatch.from_pydict({
        "group": ["g"] * n, "week": pa.array(range(n), pa.int64()), "target_up": pa.array([i % 2 for i in range(n)], pa.int32()),
        "x": pa.array(rng.random((n, 2)).tolist(), pa.list_(pa.float64())), "idx": pa.array(idx, pa.list_(pa.int32())),
        "tf": pa.array([c[i].astype(float).tolist() for c, i in zip(counts, idx)], pa.list_(pa.float64())),
    })
    fits = [L.Fit("g", k, end, 0, 0, "m", loss, text=text) for k, (end, loss, text) in enumerate([(4, "logistic", True), (9, "squared_hinge", True), (7, "logistic", False)])]
    design = L.Design(np.zeros((3, 2)), np.zeros((3, 2)), np.ones((3, 2)), rng.random((3, terms)) + 0.5, np.ones((3, 2)))
    theta, along = rng.normal(size=(3, terms + 3)), rng.normal(size=(3, terms + 3))

    class Held:
        def __init__(self, value):
            self.value = value

    whole = L._Batch(batch, {"g": 0}, True)
    assert (whole.term_counts(terms) == counts).all()
    for mode in ("slope", "product"):
        (out,) = L._sums(Held((fits, {"g": 0}, design)), Held(([0, 1, 2], theta, along)), mode)([batch])
        for fit, sums in zip(out.column("fit").to_pylist(), out.column("sums").to_pylist()):
            kind = fits[fit]
            raw = counts[: kind.end] * design.idf[fit] * kind.text
            length = np.linalg.norm(raw, axis=1)
            full = np.hstack([raw / np.where(length > 0, length, 1.0)[:, None], whole.x[: kind.end], np.ones((kind.end, 1))])
            loss, first, second = L._loss(kind, full @ theta[fit], whole.y[: kind.end], np.ones(kind.end))
            pull = second * (full @ along[fit]) if mode == "product" else first
            got = np.array(sums)
            assert np.allclose(got[: terms + 3] if mode == "product" else got[1 : terms + 4], full.T @ pull)
            if mode == "slope":
                assert np.isclose(got[0], loss.sum())
