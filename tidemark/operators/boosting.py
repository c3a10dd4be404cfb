"""Boosted trees on second-order histograms, with rows and columns drawn per tree, for all fits at once.

A round grows one tree per fit. A level is one job: tasks work out each sampled row's gradient and hessian of the
logistic loss, add them up by (fit, node, column, bin), and Spark keeps the best split of each node. Rows and columns
are drawn by hashes of the row's key and the round, so that retried tasks draw the same. The rows carry their
margins; these are brought up to date, written and read again every ``KEEP_ROUNDS`` rounds, so that a task never walks
more than that many trees for a row.

Leaves hold -rate G / (H + 1); a split needs a hessian of at least 1 on both sides and takes the largest gain
(G_l^2 / (H_l + 1) + G_r^2 / (H_r + 1) - G^2 / (H + 1)) / 2, ties by column, then bin. Margins begin at zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forest import BINS, PRIME, Forest, Tree, _bins, _factors, _nodes, drawn_features
from tidemark.operators.linear_fits import ROWS_AT_ONCE, Fit, _Batch
from tidemark.session import keep_table

KEEP_ROUNDS = 25
PENALTY, LEAST_HESSIAN = 1.0, 1.0
STATS = "tree int, node int, feature int, bin int, g double, h double, rows long"
FAR = 1 << 62


def in_sample(keys: np.ndarray, number: int, share: float) -> np.ndarray:
    """Whether a round's sample holds each row."""
    a, b = _factors(number)
    return (keys * a + b) % PRIME < share * PRIME


def _pieces(batches: Iterator[pa.RecordBatch], model: Forest, span: str) -> Iterator[tuple]:
    """(fit, batch, rows, bins, margins) for the training rows, the scored rows, or all rows of each fit's group."""
    groups = {g: i for i, g in enumerate(dict.fromkeys(f.group for f in model.fits))}
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = _Batch(whole.slice(low, ROWS_AT_ONCE), groups, False)
            margins = batch.batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(batch.batch.num_rows, -1)
            for fit, kind in enumerate(model.fits):
                first, last = {"train": (None, kind.end), "score": (kind.val_start, kind.val_end), "all": (None, FAR)}[span]
                part = batch.rows(groups[kind.group], first, last)
                if part.stop > part.start:
                    yield fit, batch, part, _bins(batch.x[part], model.medians[fit], model.edges[fit]), margins[part, fit]


def _margin(trees: Sequence[Tree], fit: int, bins: np.ndarray, margin: np.ndarray, depth: int) -> np.ndarray:
    return sum((t.chance[_nodes(t, bins, depth)] for t in trees if t.fit == fit), margin)


def _histograms(payload, depth: int, max_depth: int, row_share: float, leaves: bool) -> Callable:
    """Gradients and hessians of the nodes opened at ``depth`` by drawn column and bin, or of all leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, recent, growing, columns = payload.value
        for fit, batch, part, bins, margin in _pieces(batches, model, "train"):
            tree = growing[fit]
            keys = batch.batch.column("key").to_numpy(zero_copy_only=False)[part].astype(np.int64)
            node = _nodes(tree, bins, depth)
            some = np.flatnonzero(in_sample(keys, tree.number, row_share) & (leaves | (node >= 1 << depth)))
            if not len(some):
                continue
            p = 1 / (1 + np.exp(-_margin(recent, fit, bins, margin, max_depth)[some]))
            g, h = p - batch.y[part][some], p * (1 - p)
            feature = np.zeros((len(some), 1), np.int64) if leaves else np.repeat(columns[fit][None, :], len(some), axis=0)
            bin_ = np.zeros_like(feature) if leaves else bins[some[:, None], feature]
            code = ((node[some][:, None] * bins.shape[1] + feature) * BINS + bin_).ravel()
            cells, where = np.unique(code, return_inverse=True)
            sums = [np.bincount(where, np.repeat(v, feature.shape[1]), minlength=len(cells)) for v in (g, h, np.ones(len(some)))]
            kinds = [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.int64()]
            values = [np.full(len(cells), fit), cells // BINS // bins.shape[1], cells // BINS % bins.shape[1], cells % BINS, sums[0], sums[1], sums[2].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["tree", "node", "feature", "bin", "g", "h", "rows"])

    return run


def best_gains(stats: DataFrame) -> DataFrame:
    """(tree, node, feature, bin, gain): the split of each node with the largest second-order gain."""
    sums = stats.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    by = Window.partitionBy("tree", "node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select("tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l_{c}") for c in "gh"], *[F.sum(c).over(by).alias(f"t_{c}") for c in "gh"])
    cut = cut.where((F.col("l_h") >= LEAST_HESSIAN) & (F.col("t_h") - F.col("l_h") >= LEAST_HESSIAN))

    def worth(g, h):
        return g * g / (h + F.lit(PENALTY))

    gain = (worth(F.col("l_g"), F.col("l_h")) + worth(F.col("t_g") - F.col("l_g"), F.col("t_h") - F.col("l_h")) - worth(F.col("t_g"), F.col("t_h"))) / 2
    scored = cut.withColumn("gain", F.round(gain, 9)).where(F.col("gain") > 0)
    first = F.min(F.struct((-F.col("gain")).alias("less"), "feature", "bin")).alias("first")
    return scored.groupBy("tree", "node").agg(first).select("tree", "node", "first.feature", "first.bin", (-F.col("first.less")).alias("gain"))


def _with_margins(rows: DataFrame, model: Forest, recent: list[Tree], depth: int) -> DataFrame:
    """The rows with the recent trees in their margins, kept."""
    payload = rows.sparkSession.sparkContext.broadcast((model, recent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, trees = payload.value
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                held, now = None, None
                for fit, batch, part, bins, margin in _pieces(iter([whole.slice(low, ROWS_AT_ONCE)]), mine, "all"):
                    if held is None:
                        held = batch.batch
                        now = held.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1).copy()
                    now[part, fit] = _margin(trees, fit, bins, margin, depth)
                if held is not None:
                    sizes = pa.array(np.arange(0, now.size + 1, now.shape[1]), pa.int32())
                    at = held.schema.get_field_index("margins")
                    yield held.set_column(at, "margins", pa.ListArray.from_arrays(sizes, pa.array(now.ravel())))

    return keep_table(rows.mapInArrow(run, rows.schema))


def boost(
    rows: DataFrame, fits: Sequence[Fit], medians: np.ndarray, edges: np.ndarray, n_rounds: int = 400, max_depth: int = 4,
    learning_rate: float = 0.05, row_share: float = 0.8, column_share: float = 0.8,
) -> tuple[Forest, DataFrame]:
    """The trees of all fits, and (group, asset, week_start, target_up, model, fold, y_pred, y_score) of their scored rows.

    ``rows``: (group, asset, week, target_up, key, x). Gradients use every sampled row; nulls are imputed by the medians.
    """
    context, size = rows.sparkSession.sparkContext, medians.shape[1]
    count = max(1, int(column_share * size))
    model, recent = Forest(list(fits), medians, edges, []), []
    rows = rows.withColumn("margins", F.array_repeat(F.lit(0.0), len(fits)))
    heap = 1 << (max_depth + 1)
    for number in range(n_rounds):
        growing = [Tree(f, number, np.full(heap, -1), np.zeros(heap, np.int64), np.zeros(heap), np.ones(2), np.zeros(heap)) for f in range(len(fits))]
        columns = [drawn_features(number, 0, size, count) for _ in fits]
        bare = Forest(model.fits, medians, edges, [])

        def counted(depth: int, leaves: bool) -> DataFrame:
            payload = context.broadcast((bare, recent, growing, columns))
            return rows.mapInArrow(_histograms(payload, depth, max_depth, row_share, leaves), STATS)

        for depth in range(max_depth):
            found = best_gains(counted(depth, False)).collect()
            for r in found:
                tree = growing[r["tree"]]
                tree.feature[r["node"]], tree.bin[r["node"]], tree.gain[r["node"]] = r["feature"], r["bin"], r["gain"]
            if not found:
                break
        for r in counted(max_depth, True).groupBy("tree", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            growing[r["tree"]].chance[r["node"]] = -learning_rate * r["g"] / (r["h"] + PENALTY)
        recent = [*recent, *growing]
        model.trees.extend(growing)
        if (number + 1) % KEEP_ROUNDS == 0:
            rows, recent = _with_margins(rows, bare, recent, max_depth), []
    payload = context.broadcast((Forest(model.fits, medians, edges, []), recent))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, trees = payload.value
        for fit, batch, part, bins, margin in _pieces(batches, mine, "score"):
            total = _margin(trees, fit, bins, margin, max_depth)
            some, kind = batch.batch.slice(part.start, len(bins)), mine.fits[fit]
            yield pa.RecordBatch.from_arrays(
                [some.column("group"), some.column("asset"), pa.array(batch.weeks[part]), some.column("target_up").cast(pa.int32()), pa.array([kind.model] * len(bins)),
                 pa.array([kind.fold] * len(bins), pa.int32()), pa.array((total > 0).astype(np.int32)), pa.array(1 / (1 + np.exp(-total)))],
                ["group", "asset", "week", "target_up", "model", "fold", "y_pred", "y_score"],
            )

    scored = rows.mapInArrow(score, "group string, asset string, week long, target_up int, model string, fold int, y_pred int, y_score double")
    return model, scored.select("group", "asset", F.timestamp_micros("week").alias("week_start"), "target_up", "model", "fold", "y_pred", "y_score")
