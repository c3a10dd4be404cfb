from __future__ import annotations

import numpy as np
import pytest

from tests.test_linear_fits import SCHEMA, WEEK, numbers
from tidemark.operators import boosting as B
from tidemark.operators import forest as FO
from tidemark.operators.linear_fits import Fit

FITS = [Fit(g, fold, end * WEEK, end * WEEK, (end + 9) * WEEK, model="trees") for g in "ab" for fold, end in enumerate((30, 50))]


def rows_and_table(spark):
    keys = np.random.default_rng(9).integers(0, FO.PRIME, 240).tolist()
    rows = [(*r, key) for r, key in zip(numbers(), keys)]
    return rows, spark.createDataFrame(rows, SCHEMA + ", key long").repartition(3)


def edges_of(rows):
    size = len(rows[0][4])
    medians, edges = np.zeros((len(FITS), size)), np.zeros((len(FITS), size, FO.BINS - 1))
    for at, fit in enumerate(FITS):
        for i in range(size):
            known = [r[4][i] for r in rows if r[0] == fit.group and r[2] < fit.end and r[4][i] is not None]
            if known:
                medians[at, i] = np.median(known)
                edges[at, i] = np.quantile(known, np.arange(1, FO.BINS) / FO.BINS)
    return medians, edges


def binned(row, medians, edges):
    filled = [medians[i] if v is None else v for i, v in enumerate(row[4])]
    return [int((edges[i] < v).sum()) for i, v in enumerate(filled)]


def test_medians_and_edges_of_spans(spark):
    rows = numbers()
    table = spark.createDataFrame([(r[0], r[2], *r[4]) for r in rows], "group string, week long, a double, b double, c double, d double")
    spans = spark.createDataFrame([(i, f.group, f.end) for i, f in enumerate(FITS)], "fit int, group string, end long")
    medians, edges = FO.bin_edges(table, list("abcd"), spans, len(FITS), 1)
    expected = edges_of(rows)
    assert medians == pytest.approx(expected[0]) and edges == pytest.approx(expected[1])


def flat(splits):
    return [x for node in sorted(splits) for x in (node, *splits[node])]


def grown(data, gain_of, allowed, drawn, depth):
    """A tree in heap order from (bins, statistics) rows by trying every split of every drawn column."""
    splits, ends, todo = {}, {}, [(1, data, 0)]
    while todo:
        node, mine, level = todo.pop()
        best = None
        if level < depth:
            for feature in drawn(node):
                for cut in range(FO.BINS - 1):
                    left = [d for d in mine if d[0][feature] <= cut]
                    right = [d for d in mine if d[0][feature] > cut]
                    # Cuts between the same rows are the one at the row's own bin.
                    if not left or not right or max(d[0][feature] for d in left) != cut or not allowed(left, right):
                        continue
                    gain = round(gain_of(left) + gain_of(right) - gain_of(mine), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, feature, cut, left, right)
        if best is None:
            ends[node] = mine
        else:
            splits[node] = best[:3]
            todo += [(2 * node, best[3], level + 1), (2 * node + 1, best[4], level + 1)]
    return splits, ends


def test_a_forest_grows_as_by_hand(spark, monkeypatch):
    monkeypatch.setattr(FO, "TREES_AT_ONCE", 7)
    rows, table = rows_and_table(spark)
    medians, edges = edges_of(rows)
    forest = FO.grow_forest(table, FITS, medians, edges, n_trees=3, max_depth=3, min_leaf=4, share=2)
    assert sorted((t.fit, t.number) for t in forest.trees) == [(f, t) for f in range(4) for t in range(3)]
    for tree in forest.trees:
        fit, data = FITS[tree.fit], []
        for r in rows:
            a, b = pow(48_271, tree.number + 1, FO.PRIME), pow(16_807, tree.number + 1, FO.PRIME)
            times = int((FO.POISSON <= (r[7] * a + b) % FO.PRIME / FO.PRIME).sum())
            if r[0] == fit.group and r[2] < fit.end and times:
                data.append((binned(r, medians[tree.fit], edges[tree.fit]), times, r[3]))
        drawn_down, drawn_up = (sum(t for _, t, y in data if y == c) for c in (0, 1))
        weights = [(drawn_down + drawn_up) / (2 * n) for n in (drawn_down, drawn_up)]
        assert tree.weights == pytest.approx(weights)

        def mass(part):
            return [weights[c] * sum(t for _, t, y in part if y == c) for c in (0, 1)]

        def purity(part):
            down, up = mass(part)
            return (down * down + up * up) / (down + up)

        splits, ends = grown(data, purity, lambda l, r: len(l) >= 4 and len(r) >= 4, lambda n: FO.drawn_features(tree.number, n, 4, 2).tolist(), 3)
        assert flat({n: (tree.gain[n], tree.feature[n], tree.bin[n]) for n in np.flatnonzero(tree.feature >= 0).tolist()}) == pytest.approx(flat(splits))
        for node, part in ends.items():
            down, up = mass(part)
            assert tree.chance[node] == pytest.approx(up / (down + up))
    shares = forest.importance(0)
    assert shares.sum() == pytest.approx(1) and shares[0] > shares[2] == 0
    scores = FO.score_forest(table, forest, 3).collect()
    assert len(scores) == sum(f.group == r[0] and f.val_start <= r[2] < f.val_end for f in FITS for r in rows)
    assert np.mean([r["y_pred"] == r["target_up"] for r in scores]) > 0.6


def test_boosting_grows_as_by_hand_also_over_kept_margins(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP_ROUNDS", 2)
    rows, table = rows_and_table(spark)
    medians, edges = edges_of(rows)
    model, scored = B.boost(table, FITS, medians, edges, n_rounds=3, max_depth=2, learning_rate=0.3, row_share=0.7, column_share=0.6)
    scores = {}
    for r in scored.collect():
        scores.setdefault((r["group"], r["fold"]), []).append((r["y_score"], r["target_up"]))
    for at, fit in enumerate(FITS):
        mine = [(binned(r, medians[at], edges[at]), r) for r in rows if r[0] == fit.group]
        margin = {id(r): 0.0 for _, r in mine}
        for number in range(3):
            tree = next(t for t in model.trees if t.fit == at and t.number == number)
            a, b = pow(48_271, number + 1, FO.PRIME), pow(16_807, number + 1, FO.PRIME)
            data = []
            for bins, r in mine:
                if r[2] < fit.end and (r[7] * a + b) % FO.PRIME < 0.7 * FO.PRIME:
                    p = 1 / (1 + np.exp(-margin[id(r)]))
                    data.append((bins, p - r[3], p * (1 - p)))
            columns = FO.drawn_features(number, 0, 4, 2).tolist()
            splits, ends = grown(
                data, lambda part: sum(d[1] for d in part) ** 2 / (sum(d[2] for d in part) + 1) / 2,
                lambda l, r: sum(d[2] for d in l) >= 1 and sum(d[2] for d in r) >= 1, lambda n: columns, 2,
            )
            assert flat({n: (tree.gain[n], tree.feature[n], tree.bin[n]) for n in np.flatnonzero(tree.feature >= 0).tolist()}) == pytest.approx(flat(splits), abs=1e-8)
            value = {n: -0.3 * sum(d[1] for d in part) / (sum(d[2] for d in part) + 1) for n, part in ends.items()}
            for bins, r in mine:
                node = 1
                while node in splits:
                    node = 2 * node + (bins[splits[node][1]] > splits[node][2])
                margin[id(r)] += value[node]
        expected = sorted((1 / (1 + np.exp(-margin[id(r)])), r[3]) for _, r in mine if fit.val_start <= r[2] < fit.val_end)
        assert [s for s, _ in sorted(scores[fit.group, fit.fold])] == pytest.approx([s for s, _ in expected])
