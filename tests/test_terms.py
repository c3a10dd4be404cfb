from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import terms as T
from tidemark.operators.slices import slice_bounds
from tidemark.operators.weekly_text import clean_posts, weekly_text

TEXTS = [
    ("A", "2024-01-02", "alpha beta beta gamma"), ("A", "2024-01-03", "gamma alpha x y"),
    ("A", "2024-01-03", "?! x"), ("A", "2024-01-04", "delta alpha"), ("A", "2024-01-09", "alpha beta"),
    ("B", "2024-01-02", "beta beta gamma alpha"), ("B", "2024-01-10", "omega"), ("B", "2024-01-10", "gamma beta"),
]


def cleaned(spark):
    rows = [(a, d, t, f"id{i}", "c") for i, (a, d, t) in enumerate(TEXTS)]
    return clean_posts(
        spark.createDataFrame(rows, "asset string, created_utc string, text string, source_id string, channel string"), 1
    )


def brute_counts(spark):
    out = Counter()
    for r in weekly_text(cleaned(spark)).collect():
        words = re.findall(r"\b\w\w+\b", r["weekly_text"])
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            out[(r["asset"], r["week_start"], term)] += 1
    return out


def test_terms_equal_counting_in_the_weekly_text(spark):
    df = cleaned(spark)
    expected = brute_counts(spark)
    assert any(t == "gamma gamma" for _, _, t in expected)
    ends = df.select("asset", "week_start", F.unix_micros("created_utc").alias("_at"), "source_id", F.xxhash64("clean_text").alias("_tie"))
    some = [
        (r["asset"], r["week_start"], r["_at"], r["source_id"], r["_tie"])
        for r in ends.orderBy("asset", "week_start", "_at", "source_id").collect()
    ]
    for bounds in (None, some[1::2], some):
        got = {(r["asset"], r["week_start"], r["term"]): r["n"] for r in T.post_terms(df, bounds=bounds).collect()}
        assert got == expected
    from_text = {(r["asset"], r["week_start"], r["term"]): r["n"] for r in T.text_terms(weekly_text(df)).collect()}
    assert from_text == expected
    assert slice_bounds(ends, ["asset", "week_start", "_at", "source_id", "_tie"], rows_per_slice=2)


def test_ngram_ranges(spark):
    df = cleaned(spark)
    singles = {r["term"] for r in T.post_terms(df, (1, 1)).collect()}
    pairs = {r["term"] for r in T.post_terms(df, (2, 2)).collect()}
    assert all(" " not in t for t in singles) and all(t.count(" ") == 1 for t in pairs)
    for wrong in ((0, 1), (3, 2), (1, T.LONGEST + 1)):
        with pytest.raises(ValueError):
            T.post_terms(df, wrong)


@pytest.mark.parametrize("low, high", [(1, 3), (3, 3), (2, 5)])
def test_long_runs_span_several_short_posts(spark, low, high):
    """Posts of one and two words, so that a run covers up to five of them."""
    texts = ["one", "two two", "?!", "three", "one two", "x", "four five six seven", "one", "one", "two", "eight nine"]
    rows = [(a, f"2024-01-0{2 + i % 5}", t, f"id{i:02d}", "c") for a in "AB" for i, t in enumerate(texts if a == "A" else texts[::-1])]
    df = clean_posts(spark.createDataFrame(rows, "asset string, created_utc string, text string, source_id string, channel string"), 1)
    whole = weekly_text(df)
    expected = Counter()
    for r in whole.collect():
        words = re.findall(r"\b\w\w+\b", r["weekly_text"])
        for n in range(low, high + 1):
            for i in range(len(words) - n + 1):
                expected[r["asset"], r["week_start"], " ".join(words[i : i + n])] += 1
    order = [F.unix_micros("created_utc").alias("_at"), "source_id", F.xxhash64("clean_text").alias("_tie")]
    some = sorted(tuple(r) for r in df.select("asset", "week_start", *order).collect())
    for bounds in (None, some[1::3], some):
        assert {(r["asset"], r["week_start"], r["term"]): r["n"] for r in T.post_terms(df, (low, high), bounds).collect()} == expected
    assert {(r["asset"], r["week_start"], r["term"]): r["n"] for r in T.text_terms(whole, (low, high)).collect()} == expected


def test_tfidf_vectors(spark):
    df = cleaned(spark)
    counts = brute_counts(spark)
    cells = sorted({(a, w) for a, w, _ in counts})
    doc_freq, corpus = Counter(), Counter()
    for (a, w, t), n in counts.items():
        doc_freq[t] += 1
        corpus[t] += n
    kept = sorted(sorted((t for t in doc_freq if doc_freq[t] >= 2), key=lambda t: (-corpus[t], t))[:4])
    panel = df.select("asset", "week_start").distinct()
    fitted = T.fit_text_vectors(T.post_terms(df), panel, len(cells) + 1, max_features=4, min_df=2)
    assert list(fitted.terms) == kept
    extra = panel.unionByName(panel.limit(1).withColumn("asset", F.lit("none")))
    rows = {(r["asset"], r["week_start"]): r["text_vector"] for r in fitted.transform(extra, T.post_terms(df)).collect()}
    for a, w in cells:
        raw = [counts[(a, w, t)] * (math.log((len(cells) + 2) / (doc_freq[t] + 1)) + 1) for t in kept]
        norm = math.sqrt(sum(v * v for v in raw)) or 1.0
        assert list(rows[(a, w)].toArray()) == pytest.approx([v / norm for v in raw])
    empty = next(v for (a, _), v in rows.items() if a == "none")
    assert empty.size == 4 and empty.numNonzeros() == 0


def test_vocabulary_sees_training_weeks_only(spark):
    df = cleaned(spark)
    first_week = df.where(F.dayofmonth("week_start") == 1).select("asset", "week_start").distinct()
    fitted = T.fit_text_vectors(T.post_terms(df), first_week, 2, max_features=100, min_df=1)
    assert "omega" not in fitted.terms and "delta" in fitted.terms


def test_terms_are_counted_where_the_posts_of_a_cell_arrive(spark):
    df = cleaned(spark)
    expected = brute_counts(spark)
    for ngrams in ((1, 2), (1, 3)):
        plan = T.post_terms(df, ngrams)._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffles and not any("term" in line for line in shuffles)
    # Cells of more characters than a task takes are dealt among several, and added up.
    for chars in (1, 20, 40):
        split = T.post_terms(df, cell_chars=chars)
        assert {(r["asset"], r["week_start"], r["term"]): r["n"] for r in split.collect()} == expected


def test_shared_terms_of_any_number_of_cells(spark):
    terms = T.post_terms(cleaned(spark))
    rows = [tuple(r) for r in terms.collect()]
    held = Counter(term for _, _, term, _ in rows)
    for least in (1, 2, 3, 4):
        found = T.shared_terms(terms, least, tasks=3)
        assert Counter(tuple(r) for r in found.collect()) == Counter(r for r in rows if held[r[2]] >= least)
        plan = found.groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(term") == 1
