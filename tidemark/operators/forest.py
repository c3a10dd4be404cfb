"""Random forests with classes balanced in each bootstrap sample, grown level by level as histogram aggregations.

All trees of all fits grow together. A row's bootstrap counts are Poisson draws from a hash of its key and the tree's
number, so that any task draws the same, and nothing is copied. A level is one job: tasks place their rows in the
trees so far and count (tree, node, feature, bin) for the features drawn for the node, Spark sums the counts,
runs over the bins and keeps the best split of each node. The driver holds the trees: features and
bins of at most 2^depth nodes each.

Weights are recomputed per tree: n / (2 n_class) over the counts drawn. A split needs ``min_leaf`` different rows on
each side and is the one with the largest fall of weighted Gini impurity, ties by feature, then bin. Where none
of the drawn features splits, the node is a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import known
from tidemark.operators.linear_fits import ROWS_AT_ONCE, Fit, _Batch
from tidemark.operators.numeric_prep import SMALL_BLOCK

BINS = 32
#: Trees that grow at once; further ones follow.
TREES_AT_ONCE = 2_000
#: Fixed values of the draws: a prime, two of its primitive roots, and the Poisson(1) distribution.
PRIME, ROOTS = 2_147_483_647, (48_271, 16_807)
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
STATS = "tree int, node int, feature int, bin int, down long, up long, rows long"


def row_key(*columns: str):
    """A number below 2^31 - 1 from the columns' texts, for the draws."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(PRIME)


def _factors(tree: int) -> tuple[int, int]:
    return pow(ROOTS[0], tree + 1, PRIME), pow(ROOTS[1], tree + 1, PRIME)


def bootstrap_counts(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often the tree's sample holds each row."""
    a, b = _factors(tree)
    return np.searchsorted(POISSON, (keys * a + b) % PRIME / PRIME, side="right")


def drawn_features(tree: int, node: int, size: int, count: int) -> np.ndarray:
    """The features a node may split on, sorted."""
    a, b = _factors(tree)
    place = (np.arange(1, size + 1, dtype=np.int64) * a + (node * b) % PRIME) % PRIME
    return np.sort(np.argsort(place * np.int64(ROOTS[0]) % PRIME, kind="stable")[:count])


@dataclass
class Tree:
    """A binary tree in heap order from node 1: feature and bin of each split, feature -1 in leaves."""

    fit: int
    number: int
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    weights: np.ndarray
    chance: np.ndarray


@dataclass
class Forest:
    """Trees of several fits with each fit's imputation medians and bin edges (fits x columns x bins - 1)."""

    fits: list[Fit]
    medians: np.ndarray
    edges: np.ndarray
    trees: list[Tree]

    def importance(self, fit: int) -> np.ndarray:
        """Each feature's share in the fall of impurity, averaged over the trees that split; zeros without any."""
        shares = []
        for tree in (t for t in self.trees if t.fit == fit and (t.feature >= 0).any()):
            total = np.bincount(tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0], minlength=self.medians.shape[1])
            shares.append(total / total.sum())
        return np.mean(shares, axis=0) if shares else np.zeros(self.medians.shape[1])


def bin_edges(rows: DataFrame, columns: Sequence[str], spans: DataFrame, n_fits: int, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians and quantiles at 1/32 to 31/32 of each fit's known training values, exact up to ``SMALL_BLOCK`` rows."""
    spread = rows.join(F.broadcast(spans), "group").where(F.col("week") < F.col("end"))
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    exact = most_rows <= SMALL_BLOCK
    parts = []
    for i, c in enumerate(columns):
        value = known(F.col(f"`{c}`"))
        parts += [F.percentile(value, shares).alias(f"q{i}"), F.median(value).alias(f"m{i}")] if exact else [
            F.percentile_approx(value, shares, 10_000).alias(f"q{i}"), F.percentile_approx(value, 0.5, 10_000).alias(f"m{i}")]
    medians, edges = np.zeros((n_fits, len(columns))), np.zeros((n_fits, len(columns), BINS - 1))
    for r in spread.groupBy("fit").agg(*parts).collect():
        for i in range(len(columns)):
            if r[f"m{i}"] is not None:
                medians[r["fit"], i], edges[r["fit"], i] = r[f"m{i}"], r[f"q{i}"]
    return medians, edges


def _bins(x: np.ndarray, medians: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value: the number of edges below it."""
    filled = np.where(np.isnan(x), medians, x)
    return np.stack([np.searchsorted(edges[i], filled[:, i], side="left") for i in range(x.shape[1])], axis=1)


def _nodes(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after at most ``depth`` splits."""
    node = np.ones(len(bins), np.int64)
    for _ in range(depth):
        feature = tree.feature[node]
        right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > tree.bin[node]
        node = np.where(feature >= 0, 2 * node + right, node)
    return node


def _parts(batches: Iterator[pa.RecordBatch], forest: Forest, scored: bool) -> Iterator[tuple]:
    """For each fit its rows of a piece: (fit, batch, rows, bins)."""
    groups = {g: i for i, g in enumerate(dict.fromkeys(f.group for f in forest.fits))}
    used = sorted({t.fit for t in forest.trees})
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = _Batch(whole.slice(low, ROWS_AT_ONCE), groups, False)
            for fit in used:
                kind = forest.fits[fit]
                part = batch.rows(groups[kind.group], kind.val_start if scored else None, kind.val_end if scored else kind.end)
                if part.stop > part.start:
                    yield fit, batch, part, _bins(batch.x[part], forest.medians[fit], forest.edges[fit])


def _histograms(payload, depth: int, count: int, leaves: bool) -> Callable:
    """Counts of the nodes opened at ``depth`` by drawn feature and bin, or of all leaves (feature and bin 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = payload.value
        drawn = {}
        for fit, batch, part, bins in _parts(batches, forest, False):
            keys = batch.batch.column("key").to_numpy(zero_copy_only=False)[part].astype(np.int64)
            y = batch.y[part]
            out = []
            for at, tree in enumerate(forest.trees):
                if tree.fit != fit:
                    continue
                times = bootstrap_counts(keys, tree.number)
                node = _nodes(tree, bins, depth)
                some = np.flatnonzero((times > 0) & (leaves | (node >= 1 << depth)))
                if not len(some):
                    continue
                node, time, up = node[some], times[some], y[some] > 0
                if leaves:
                    feature, bin_ = np.zeros((len(some), 1), np.int64), np.zeros((len(some), 1), np.int64)
                else:
                    for n in np.unique(node).tolist():
                        if (at, n) not in drawn:
                            drawn[at, n] = drawn_features(tree.number, n, bins.shape[1], count)
                    feature = np.stack([drawn[at, n] for n in node.tolist()])
                    bin_ = bins[some[:, None], feature]
                code = ((node[:, None] * bins.shape[1] + feature) * BINS + bin_).ravel()
                cells, where = np.unique(code, return_inverse=True)
                width = feature.shape[1]
                sums = [np.bincount(where, np.repeat(v, width), minlength=len(cells)).astype(np.int64) for v in (time * ~up, time * up, np.ones(len(some)))]
                out.append((np.full(len(cells), at), cells // BINS // bins.shape[1], cells // BINS % bins.shape[1], cells % BINS, *sums))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                kinds = [pa.int32()] * 4 + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "node", "feature", "bin", "down", "up", "rows"])

    return run


def best_splits(stats: DataFrame, weights: DataFrame, min_leaf: int) -> DataFrame:
    """(tree, node, feature, bin, gain): the split of each node with the largest fall of weighted impurity."""
    sums = stats.groupBy("tree", "node", "feature", "bin").agg(F.sum("down").alias("down"), F.sum("up").alias("up"), F.sum("rows").alias("rows"))
    by = Window.partitionBy("tree", "node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select("tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l_{c}") for c in ("down", "up", "rows")], *[F.sum(c).over(by).alias(f"t_{c}") for c in ("down", "up", "rows")])
    cut = cut.where((F.col("l_rows") >= min_leaf) & (F.col("t_rows") - F.col("l_rows") >= min_leaf)).join(F.broadcast(weights), "tree")

    def purity(down, up):
        d, u = down * F.col("w_down"), up * F.col("w_up")
        return (d * d + u * u) / (d + u)

    gain = purity(F.col("l_down"), F.col("l_up")) + purity(F.col("t_down") - F.col("l_down"), F.col("t_up") - F.col("l_up")) - purity(F.col("t_down"), F.col("t_up"))
    # Equal gains up to rounding are ties.
    scored = cut.withColumn("gain", F.round(gain, 9)).where(F.col("gain") > 0)
    first = F.min(F.struct((-F.col("gain")).alias("less"), "feature", "bin")).alias("first")
    return scored.groupBy("tree", "node").agg(first).select("tree", "node", "first.feature", "first.bin", (-F.col("first.less")).alias("gain"))


def grow_forest(
    rows: DataFrame, fits: Sequence[Fit], medians: np.ndarray, edges: np.ndarray, n_trees: int = 300, max_depth: int = 8, min_leaf: int = 8, share: int | None = None
) -> Forest:
    """Forests of all fits from rows (group, week, target_up, key, x).

    ``share`` features are drawn for each node, by default the root of their number. A fit whose sample holds a
    single class grows no tree of that number beyond its root.
    """
    size = medians.shape[1]
    count = share or max(1, int(math.sqrt(size)))
    spark = rows.sparkSession
    every = [(f, t) for f in range(len(fits)) for t in range(n_trees)]
    done: list[Tree] = []
    for low in range(0, len(every), TREES_AT_ONCE):
        heap = 1 << (max_depth + 1)
        trees = [Tree(f, t, np.full(heap, -1), np.zeros(heap, np.int64), np.zeros(heap), np.ones(2), np.full(heap, 0.5)) for f, t in every[low : low + TREES_AT_ONCE]]
        forest = Forest(list(fits), medians, edges, trees)

        def counted(depth: int, leaves: bool) -> DataFrame:
            return rows.mapInArrow(_histograms(spark.sparkContext.broadcast(forest), depth, count, leaves), STATS)

        classes = counted(0, True).groupBy("tree").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).collect()
        table = []
        for r in classes:
            n = r["down"] + r["up"]
            if r["down"] and r["up"]:
                trees[r["tree"]].weights = np.array([n / (2 * r["down"]), n / (2 * r["up"])])
                table.append((r["tree"], *trees[r["tree"]].weights.tolist()))
        weights = spark.createDataFrame(table, "tree int, w_down double, w_up double")
        for depth in range(max_depth):
            found = best_splits(counted(depth, False), weights, min_leaf).collect()
            if not found:
                break
            for r in found:
                tree = trees[r["tree"]]
                tree.feature[r["node"]], tree.bin[r["node"]], tree.gain[r["node"]] = r["feature"], r["bin"], r["gain"]
        for r in counted(max_depth, True).groupBy("tree", "node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).collect():
            w = trees[r["tree"]].weights
            trees[r["tree"]].chance[r["node"]] = w[1] * r["up"] / (w[0] * r["down"] + w[1] * r["up"])
        done += trees
    return Forest(list(fits), medians, edges, done)


def score_forest(rows: DataFrame, forest: Forest, max_depth: int = 8) -> DataFrame:
    """(group, asset, week_start, target_up, model, fold, y_pred, y_score): the mean chance over a fit's trees."""
    payload = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Forest = payload.value
        for fit, batch, part, bins in _parts(batches, mine, True):
            trees = [t for t in mine.trees if t.fit == fit]
            score = sum(t.chance[_nodes(t, bins, max_depth)] for t in trees) / len(trees)
            some, kind = batch.batch.slice(part.start, len(bins)), mine.fits[fit]
            yield pa.RecordBatch.from_arrays(
                [some.column("group"), some.column("asset"), pa.array(batch.weeks[part]), some.column("target_up").cast(pa.int32()), pa.array([kind.model] * len(bins)),
                 pa.array([kind.fold] * len(bins), pa.int32()), pa.array((score > 0.5).astype(np.int32)), pa.array(score)],
                ["group", "asset", "week", "target_up", "model", "fold", "y_pred", "y_score"],
            )

    out = rows.mapInArrow(run, "group string, asset string, week long, target_up int, model string, fold int, y_pred int, y_score double")
    return out.select("group", "asset", F.timestamp_micros("week").alias("week_start"), "target_up", "model", "fold", "y_pred", "y_score")
