"""Many penalised linear classifiers fitted together: every step is one job over the rows for all fits.

A fit is a span of weeks of one group (an asset, a variant, or all), with a loss. Spans of folds are nested, so the
rows are neither copied per fold nor read per fold: a task sorts each batch by (group, week) and takes a
prefix for each fit. Raw columns become features inside the task, by each fit's own medians, deviations and
inverse document frequencies. Tasks add up loss, gradient and curvature per fit; one small row per task and
fit is shuffled, and the driver takes a Newton step for all fits at once. Fits on numbers alone solve with the whole
Gram matrix; fits with text use conjugate gradients, preconditioned with it, where each product with the curvature is
such a job.

The driver and each task hold the parameters of a block of fits, at most ``BLOCK_NUMBERS`` numbers; further fits
go into further blocks. Rows are read from the given table each time, so keep or cache a narrow one.

Losses, with class weights and the penalty 1/2 |w|^2: ``logistic`` C log(1 + exp(-y m)), ``squared_hinge``
C max(0, 1 - y m)^2. The intercept is penalised where the fit says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import known
from tidemark.operators.numeric_prep import SMALL_BLOCK, exact_medians

#: Numbers of all parameters (of Gram matrices, where those are used) that one block of fits may have.
BLOCK_NUMBERS = 2_000_000
#: Rows of a batch that are unpacked at once, and numbers of their dense matrix of term counts.
ROWS_AT_ONCE, DENSE_NUMBERS = 1024, 4_000_000
MAX_STEPS, MAX_PRODUCTS = 100, 400


@dataclass(frozen=True)
class Fit:
    """Rows of ``group`` before ``end`` train, rows in [val_start, val_end) are scored (microseconds)."""

    group: str
    fold: int
    end: int
    val_start: int
    val_end: int
    model: str = ""
    loss: str = "logistic"
    c: float = 1.0
    penalise_intercept: bool = False
    text: bool = False
    numeric: bool = True


@dataclass
class Design:
    """What each fit makes of the raw columns: imputation, scaling, term weights, class weights."""

    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    idf: np.ndarray
    weights: np.ndarray

    def of(self, fits: slice) -> Design:
        return Design(self.medians[fits], self.means[fits], self.deviations[fits], self.idf[fits], self.weights[fits])


def numeric_design(rows: DataFrame, columns: Sequence[str], spans: DataFrame, n_fits: int, most_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians, means and population deviations of each fit's training rows after imputation, from one expanded pass.

    ``spans`` holds (fit, group, end). A column without a value in a span gets median 0, a constant one deviation 1.
    Up to ``SMALL_BLOCK`` training rows medians are plain aggregates, beyond that they are ranked in slices.
    """
    spread = rows.join(F.broadcast(spans), "group").where(F.col("week") < F.col("end"))
    value = {c: known(F.col(f"`{c}`")) for c in columns}
    small = most_rows <= SMALL_BLOCK
    parts = []
    for i, c in enumerate(columns):
        v = value[c]
        parts += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        parts += [F.median(v).alias(f"d{i}")] if small else []
    found = spread.groupBy("fit").agg(F.count("*").alias("rows"), *parts).collect()
    size = len(columns)
    medians, means, deviations = np.zeros((n_fits, size)), np.zeros((n_fits, size)), np.ones((n_fits, size))
    ranked = {}
    if not small:
        ranked = {(r["fit"], r["column_name"]): r["median"] for r in exact_medians(spread.select("fit", *columns), columns, ["fit"]).collect()}
    for r in found:
        for i, c in enumerate(columns):
            if not r[f"n{i}"]:
                continue
            n, missing = r[f"n{i}"], r["rows"] - r[f"n{i}"]
            median = r[f"d{i}"] if small else ranked[r["fit"], c]
            mean = (n * r[f"m{i}"] + missing * median) / (n + missing)
            spread_out = (n * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) + missing * (median - mean) ** 2) / (n + missing)
            medians[r["fit"], i], means[r["fit"], i] = median, mean
            # Equal values need no scaling, whatever rounding leaves of their variance.
            deviations[r["fit"], i] = 1.0 if r[f"l{i}"] == r[f"h{i}"] else spread_out**0.5
    return medians, means, deviations


class _Batch:
    """Rows of a record batch in the order of (group, week), as arrays."""

    def __init__(self, batch: pa.RecordBatch, groups: dict[str, int], text: bool) -> None:
        codes = np.array([groups.get(g, -1) for g in batch.column("group").to_pylist()], np.int64)
        weeks = batch.column("week").to_numpy(zero_copy_only=False)
        order = np.lexsort([weeks, codes])
        batch = batch.take(pa.array(order))
        self.batch, self.codes, self.weeks = batch, codes[order], weeks[order]
        self.y = batch.column("target_up").to_numpy(zero_copy_only=False).astype(float)
        x = batch.column("x")
        self.x = np.asarray(x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
        self.at = np.zeros(batch.num_rows + 1, np.int64)
        self.idx, self.tf = np.zeros(0, np.int64), np.zeros(0)
        if text:
            sizes = np.nan_to_num(batch.column("idx").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            self.at[1:] = np.cumsum(sizes)
            self.idx = batch.column("idx").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            self.tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(float)

    def rows(self, code: int, low: int | None, high: int) -> slice:
        """Rows of a group with low <= week < high."""
        first, last = np.searchsorted(self.codes, [code, code + 1])
        start = first if low is None else first + int(np.searchsorted(self.weeks[first:last], low))
        return slice(start, first + int(np.searchsorted(self.weeks[first:last], high)))

    def term_counts(self, terms: int) -> np.ndarray:
        """The rows' term counts as one matrix, which all fits share."""
        out = np.zeros((len(self.y), terms))
        out[np.repeat(np.arange(len(self.y)), np.diff(self.at)), self.idx] = self.tf
        return out

    def features(self, part: slice, design: Design, fit: int, kind: Fit) -> _Features:
        return _Features(self, part, design, fit, kind)


def _numbers(batch: _Batch, part: slice, design: Design, fit: int, kind: Fit) -> np.ndarray:
    """One fit's scaled numbers of some rows, and a one."""
    x = batch.x[part]
    numbers = (np.where(np.isnan(x), design.medians[fit], x) - design.means[fit]) / design.deviations[fit]
    return np.concatenate([numbers if kind.numeric else numbers * 0.0, np.ones((len(x), 1))], axis=1)


class _Features:
    """One fit's features of some rows: sparse unit vectors of term weights, scaled numbers, and a one."""

    def __init__(self, batch: _Batch, part: slice, design: Design, fit: int, kind: Fit) -> None:
        x = batch.x[part]
        self.dense = _numbers(batch, part, design, fit, kind)
        self.terms, self.count = design.idf.shape[1], len(x)
        low, high = batch.at[part.start], batch.at[part.stop]
        if kind.text and high > low:
            self.idx = batch.idx[low:high]
            self.row = np.repeat(np.arange(len(x)), np.diff(batch.at[part.start : part.stop + 1]))
            value = batch.tf[low:high] * design.idf[fit][self.idx]
            length = np.sqrt(np.bincount(self.row, value * value, minlength=len(x)))
            self.value = value / np.where(length > 0, length, 1.0)[self.row]
        else:
            self.idx = self.row = np.zeros(0, np.int64)
            self.value = np.zeros(0)

    def times(self, theta: np.ndarray) -> np.ndarray:
        out = self.dense @ theta[self.terms :]
        return out + np.bincount(self.row, self.value * theta[self.idx], minlength=self.count) if len(self.row) else out


def _loss(kind: Fit, margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its first and its second derivative by the margin, per row."""
    if kind.loss == "squared_hinge":
        sign = 2 * y - 1
        gap = np.maximum(0.0, 1 - sign * margin)
        return weight * gap * gap, -2 * weight * sign * gap, 2 * weight * (gap > 0)
    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    return weight * np.logaddexp(0.0, np.where(y > 0, -margin, margin)), weight * (p - y), weight * p * (1 - p)


def _sums(fixed, moving, mode: str) -> Callable:
    """Per task and fit: loss, gradient and the Gram matrix of numbers and intercept (``slope``), or the curvature's product (``product``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, groups, design = fixed.value
        some, theta, along = moving.value
        terms = design.idf.shape[1]
        at_once = max(1, min(ROWS_AT_ONCE, DENSE_NUMBERS // max(1, terms)))
        idf = design.idf[some] * np.array([[float(fits[fit].text)] for fit in some]) if terms else None
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, at_once):
                batch = _Batch(whole.slice(low, at_once), groups, terms > 0)
                # The text of all fits by matrix products: unit vectors are counts times idf over their length.
                margins = bends = pulls = None
                if terms:
                    counts = batch.term_counts(terms)
                    lengths = np.sqrt((counts * counts) @ (idf * idf).T)
                    lengths[lengths == 0] = 1.0
                    margins = counts @ (idf * theta[:, :terms]).T / lengths
                    bends = counts @ (idf * along[:, :terms]).T / lengths if mode == "product" else None
                    pulls = np.zeros_like(margins)
                found: dict[int, tuple] = {}
                for place, fit in enumerate(some):
                    kind = fits[fit]
                    part = batch.rows(groups[kind.group], None, kind.end)
                    if part.stop <= part.start:
                        continue
                    dense = _numbers(batch, part, design, fit, kind)
                    margin = dense @ theta[place, terms:]
                    if terms:
                        margin += margins[part, place]
                    y = batch.y[part]
                    weight = kind.c * design.weights[fit][y.astype(np.int64)]
                    loss, first, second = _loss(kind, margin, y, weight)
                    if mode == "product":
                        bend = dense @ along[place, terms:]
                        pull = second * (bend + bends[part, place] if terms else bend)
                        before, after = [], []
                    else:
                        pull = first
                        before, after = [loss.sum()], ((dense * second[:, None]).T @ dense).ravel()
                    if terms:
                        pulls[part, place] = pull
                    found[place] = before, dense.T @ pull, after
                text = (pulls / lengths).T @ counts * idf if terms else np.zeros((len(some), 0))
                for place, (before, numbers, after) in found.items():
                    out = np.concatenate([before, text[place], numbers, after])
                    fit = some[place]
                    total[fit] = total[fit] + out if fit in total else out
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["fit", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all tasks, per fit."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for fit, sums in zip(batch.column("fit").to_pylist(), batch.column("sums")):
            values = sums.values.to_numpy(zero_copy_only=False)
            total[fit] = total[fit] + values if fit in total else values
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["fit", "sums"])


def _total(rows: DataFrame, fixed, mode: str, some: np.ndarray, theta: np.ndarray, along: np.ndarray | None, out: np.ndarray) -> np.ndarray:
    """One job: the sums of the fits ``some``, put into the rows of ``out``."""
    moving = rows.sparkSession.sparkContext.broadcast((some.tolist(), theta[some], None if along is None else along[some]))
    try:
        parts = rows.mapInArrow(_sums(fixed, moving, mode), "fit int, sums array<double>").repartition("fit").mapInArrow(_added, "fit int, sums array<double>")
        for batch in parts.toArrow().to_batches():
            out[batch.column("fit").to_numpy()] = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1)
    finally:
        moving.unpersist()
    return out


def _groups(fits: Sequence[Fit]) -> dict[str, int]:
    return {g: i for i, g in enumerate(dict.fromkeys(f.group for f in fits))}


def _minimise(rows: DataFrame, fits: list[Fit], design: Design, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The parameters of each fit of a block, and its largest slope."""
    terms, numbers = design.idf.shape[1], design.medians.shape[1]
    size, whole = terms + numbers + 1, terms == 0
    penalty = np.ones((len(fits), size))
    free = np.ones((len(fits), size), bool)
    for i, fit in enumerate(fits):
        penalty[i, -1] = 1.0 if fit.penalise_intercept else 0.0
        free[i, :terms] = fit.text
        free[i, terms : size - 1] = fit.numeric

    fixed = rows.sparkSession.sparkContext.broadcast((fits, _groups(fits), design))

    def total(mode: str, theta: np.ndarray, along: np.ndarray | None, some: np.ndarray) -> np.ndarray:
        width = size if mode == "product" else 1 + size + (numbers + 1) ** 2
        return _total(rows, fixed, mode, some, theta, along, np.zeros((len(fits), width)))

    def values(theta: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = total("slope", theta, None, some)
        height = out[:, 0] + 0.5 * (penalty * theta * theta).sum(axis=1)
        slope = (out[:, 1 : 1 + size] + penalty * theta) * free
        # Fixed parameters keep a one on the diagonal, so that the systems stay solvable.
        own = free[:, terms:]
        gram = out[:, 1 + size :].reshape(len(fits), numbers + 1, numbers + 1) * own[:, :, None] * own[:, None, :]
        gram += np.eye(numbers + 1) * np.where(own, penalty[:, terms:], 1.0)[:, None, :]
        return height, slope, gram

    def product(theta: np.ndarray, along: np.ndarray, some: np.ndarray) -> np.ndarray:
        return (total("product", theta, along, some) + penalty * along) * free

    def solved(gram: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Exact for numbers and intercept, the penalty alone for terms, whose vectors have unit length."""
        out = rest.copy()
        out[:, terms:] = np.linalg.solve(gram, rest[:, terms:, None])[:, :, 0]
        return out

    def conjugate(theta: np.ndarray, slope: np.ndarray, gram: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Newton's direction for all fits in ``some``, as exact as the slope asks for."""
        step, rest = np.zeros_like(slope), -slope
        near = solved(gram, rest)
        along, length = near.copy(), (rest * near).sum(axis=1)
        norm = np.abs(rest).max(axis=1)
        goal = np.maximum(np.minimum(0.1, np.sqrt(norm)) * norm, 0.1 * tolerance)
        todo = some
        for _ in range(MAX_PRODUCTS):
            todo = todo[np.abs(rest[todo]).max(axis=1) > goal[todo]]
            if not len(todo):
                break
            bent = product(theta, along, todo)
            a = length[todo] / (along[todo] * bent[todo]).sum(axis=1)
            step[todo] += a[:, None] * along[todo]
            rest[todo] -= a[:, None] * bent[todo]
            near = solved(gram[todo], rest[todo])
            now = (rest[todo] * near).sum(axis=1)
            along[todo] = near + (now / length[todo])[:, None] * along[todo]
            length[todo] = now
        return step

    theta = np.zeros((len(fits), size))
    todo = np.arange(len(fits))
    height, slope, gram = values(theta, todo)
    for _ in range(MAX_STEPS):
        todo = todo[np.abs(slope[todo]).max(axis=1) > tolerance]
        if not len(todo):
            break
        step = np.zeros_like(theta)
        if whole:
            step[todo] = solved(gram[todo], -slope[todo])
        else:
            step = conjugate(theta, slope, gram, todo)
        drop = (step * slope).sum(axis=1)
        share, open_ = np.ones(len(fits)), todo
        # Halve the step of those fits whose loss did not fall enough.
        while len(open_):
            tried = theta.copy()
            tried[open_] = theta[open_] + share[open_, None] * step[open_]
            new_height, new_slope, new_gram = values(tried, open_)
            good = new_height[open_] <= height[open_] + 1e-4 * share[open_] * drop[open_] + 1e-12 * np.abs(height[open_])
            good |= share[open_] < 1e-8
            done = open_[good]
            theta[done], height[done], slope[done], gram[done] = tried[done], new_height[done], new_slope[done], new_gram[done]
            open_ = open_[~good]
            share[open_] /= 2
    fixed.unpersist()
    return theta, np.abs(slope).max(axis=1)


def fit_linear(rows: DataFrame, fits: Sequence[Fit], design: Design, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The parameters (terms, numbers, intercept) of all fits and the largest component of each one's last gradient.

    ``rows``: (group, week, target_up, x, and idx, tf for text). ``tolerance`` bounds each component of the
    gradient of the penalised loss.
    """
    terms, numbers = design.idf.shape[1], design.medians.shape[1]
    size = terms + numbers + 1
    at_once = max(1, BLOCK_NUMBERS // (size if terms else size * size))
    parts = [_minimise(rows, list(fits[i : i + at_once]), design.of(slice(i, i + at_once)), tolerance) for i in range(0, len(fits), at_once)]
    if not parts:
        return np.zeros((0, size)), np.zeros(0)
    return np.concatenate([theta for theta, _ in parts]), np.concatenate([slope for _, slope in parts])


def score_linear(rows: DataFrame, fits: Sequence[Fit], design: Design, theta: np.ndarray) -> DataFrame:
    """(group, asset, week_start, target_up, model, fold, y_pred, y_score) of the rows each fit has to score."""
    size = theta.shape[1]
    at_once = max(1, BLOCK_NUMBERS // size)
    out = None
    for i in range(0, len(fits), at_once):
        some = list(fits[i : i + at_once])
        payload = rows.sparkSession.sparkContext.broadcast((some, _groups(some), design.of(slice(i, i + at_once)), theta[i : i + at_once]))
        part = rows.mapInArrow(_scores(payload), "group string, asset string, week long, target_up int, model string, fold int, y_pred int, y_score double")
        out = part if out is None else out.union(part)
    return out.select("group", "asset", F.timestamp_micros("week").alias("week_start"), "target_up", "model", "fold", "y_pred", "y_score")


def _scores(payload) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, groups, design, theta = payload.value
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = _Batch(whole.slice(low, ROWS_AT_ONCE), groups, design.idf.shape[1] > 0)
                for fit, kind in enumerate(fits):
                    part = batch.rows(groups[kind.group], kind.val_start, kind.val_end)
                    count = part.stop - part.start
                    if count <= 0:
                        continue
                    margin = batch.features(part, design, fit, kind).times(theta[fit])
                    rows = batch.batch.slice(part.start, count)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("group"), rows.column("asset"), pa.array(batch.weeks[part]), rows.column("target_up").cast(pa.int32()),
                         pa.array([kind.model] * count), pa.array([kind.fold] * count, pa.int32()), pa.array((margin > 0).astype(np.int32)),
                         pa.array(1 / (1 + np.exp(-np.clip(margin, -700, 700))))],
                        ["group", "asset", "week", "target_up", "model", "fold", "y_pred", "y_score"],
                    )

    return run
