from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.panel import label_weeks, relabel
from tidemark.operators.weekly_text import (
    channel_counts, clean_posts, weekly_text, weekly_text_features, weekly_text_pieces,
)
from tidemark.plans.panel import weekly_panel
from tidemark.schemas import POSTS, empty
from tidemark.settings import LabelSettings, PostSettings, StudySettings, TextSettings

POST_DDL = (
    "asset string, created_utc string, text string, source_id string, author string, "
    "score long, num_comments long, channel string"
)


def study(**label):
    return StudySettings(
        posts=PostSettings(min_text_length=1),
        text=TextSettings(keyword_lexicon=("coin", "rally", "sell")),
        label=LabelSettings(**label),
    )


def posts_and_bars(spark):
    """Five weeks of two bars each, with posts in the second and fourth week."""
    posts = spark.createDataFrame(
        [
            ("TIN", "2021-06-09T07:00:00Z", "miners sell before the coin fair", "q1", "eve", 5, 4, "metals"),
            ("TIN", "2021-06-13T23:00:00Z", "smelter reopens", "q2", "max", 1, 0, "plants"),
            ("TIN", "2021-06-24T12:00:00Z", "rally rally", "q3", "eve", 0, 2, "metals"),
        ],
        POST_DDL,
    )
    closes = ((50, 40), (44, 50), (55, 25), (24, 30), (31, 33))
    bars = spark.createDataFrame(
        [
            ("TIN", f"2021-{day:%m-%d}", float(close), close + 2.0, close - 2.0, float(close), 7.0)
            for week, pair in enumerate(closes)
            for day, close in zip((date(2021, 5, 31) + timedelta(weeks=week), date(2021, 6, 3) + timedelta(weeks=week)), pair)
        ],
        "asset string, date string, open double, high double, low double, close double, volume double",
    )
    return posts, bars


def test_five_weeks_give_four_labelled_rows(spark):
    posts, bars = posts_and_bars(spark)
    rows = weekly_panel(posts, bars, study(), with_text=True).orderBy("week_start", "asset").collect()
    # Weeks close at 40, 50, 25, 30 and 33.
    assert [r["mkt_close"] for r in rows] == [40.0, 50.0, 25.0, 30.0]
    assert [r["future_return_h"] for r in rows] == pytest.approx([0.25, -0.5, 0.2, 0.1])
    assert [r["target_up"] for r in rows] == [1, 0, 1, 1]
    assert [r["post_count"] for r in rows] == [0.0, 2.0, 0.0, 1.0]
    assert [r["post_keyword_hits_sum"] for r in rows] == [0.0, 2.0, 0.0, 2.0]
    assert [r["post_channel_metals_count"] for r in rows] == [0.0, 1.0, 0.0, 1.0]
    assert [r["post_channel_plants_count"] for r in rows] == [0.0, 1.0, 0.0, 0.0]
    assert [r["weekly_text"] for r in rows] == ["", "miners sell before the coin fair smelter reopens", "", "rally rally"]
    assert [r["naive_persistence_signal"] for r in rows] == [0, 1, 0, 1]


def test_labels_at_the_threshold_are_neutral(spark):
    weekly = spark.createDataFrame(
        [("a", i, r) for i, r in enumerate([0.0, 0.25, -0.25, 0.26, -0.26, None, 0.1])],
        "asset string, week_start int, mkt_ret_1w double",
    )
    kept = label_weeks(weekly, 1, 0.25, drop_neutral=False).orderBy("week_start").collect()
    assert [(r["week_start"], r["target_up"]) for r in kept] == [(0, None), (1, None), (2, 1), (3, 0), (5, None)]
    assert [r["week_start"] for r in label_weeks(weekly, 1, 0.25).orderBy("week_start").collect()] == [2, 3]
    assert [r["future_return_h"] for r in label_weeks(weekly, 2, 0.0).orderBy("week_start").collect()] == [
        -0.25, 0.26, -0.26, 0.1
    ]
    undropped = label_weeks(weekly, 1, 0.25, drop_neutral=False)
    assert relabel(undropped, 0.1).count() == 4
    assert relabel(undropped, 0.25).count() == 2


def edge_posts(spark):
    return spark.createDataFrame(
        [
            ("A", "2024-01-07T23:59:59Z", "second post of the week", "b", None, 4, 2, "x"),
            ("A", "2024-01-07T10:00:00Z", "first post of the week!", "c", "u1", 1, 0, "y"),
            ("A", "2024-01-07T23:59:59Z", "tied with another post", "a", None, None, 1, None),
            ("A", "2024-01-08T00:00:00Z", "belongs to the next week", "d", "u1", -3, 0, "x"),
            ("A", "2024-01-08T01:00:00Z", None, "e", "u2", 1, 0, "x"),
            ("A", "2024-01-08T01:00:00Z", "https://only.link/here", "f", "u2", 1, 0, "x"),
            (None, "2024-01-08T01:00:00Z", "a post without any asset", "g", "u2", 1, 0, "x"),
        ],
        POST_DDL,
    )


def test_edge_posts(spark):
    rows = weekly_text_features(edge_posts(spark), ["post"], min_text_length=15).orderBy("week_start").collect()
    first, second = rows
    assert (first["post_count"], second["post_count"]) == (3.0, 1.0)
    assert first["post_unique_authors"] == 2.0
    assert first["post_score_sum"] == 5.0 and first["post_score_mean"] == 2.5
    assert first["post_comments_mean"] == 1.0
    assert first["post_channel_nunique"] == 2.0
    assert (first["post_channel_x_count"], first["post_channel_y_count"]) == (1.0, 1.0)
    assert first["post_lex_sentiment_std"] >= 0.0 and second["post_lex_sentiment_std"] == 0.0
    counts = channel_counts(clean_posts(edge_posts(spark))).collect()
    assert sorted((r["channel"], r["posts"]) for r in counts) == [("x", 1.0), ("x", 1.0), ("y", 1.0)]


def test_no_posts_still_have_every_column(spark):
    out = weekly_text_features(empty(spark, POSTS), ["a"], channels=["x"])
    assert out.count() == 0
    assert {"post_count", "post_lex_sentiment_mean", "post_channel_x_count"} <= set(out.columns)


def test_weekly_text_in_posting_order_whole_or_refused(spark):
    cleaned = clean_posts(edge_posts(spark), 15)
    texts = {r["week_start"].day: r["weekly_text"] for r in weekly_text(cleaned).collect()}
    whole = "first post of the week tied with another post second post of the week"
    assert texts == {1: whole, 8: "belongs to the next week"}
    for size in (1, 10, 30, 1000):
        pieces = weekly_text_pieces(cleaned, size).where(F.dayofmonth("week_start") == 1).orderBy("piece").collect()
        assert " ".join(p["piece_text"] for p in pieces) == whole
        assert sum(p["posts"] for p in pieces) == 3
    with pytest.raises(Exception, match="longer than 16 characters"):
        weekly_text(cleaned, max_chars=16).collect()


def test_cleaned_posts_saved_once_give_the_same_panel_and_terms(spark, tmp_path):
    from tidemark.plans.panel import save_clean_posts, weekly_terms

    posts, bars = posts_and_bars(spark)
    saved = save_clean_posts(posts, str(tmp_path / "cleaned.parquet"), study())
    direct = weekly_panel(posts, bars, study()).orderBy("week_start")
    again = weekly_panel(None, bars, study(), cleaned=saved).orderBy("week_start")
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in direct.collect()]
    terms = {(r["week_start"], r["term"], r["n"]) for r in weekly_terms(cleaned=saved, settings=study()).collect()}
    assert terms == {(r["week_start"], r["term"], r["n"]) for r in weekly_terms(posts, study()).collect()}
