from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sentiment as S
from tidemark.operators.weekly_text import weekly_text_features

POST_DDL = (
    "asset string, created_utc string, text string, source_id string, author string, "
    "score long, num_comments long, channel string"
)


def posts(spark):
    """Three posts of one week, from Sunday-ended 2022-11-14."""
    return spark.createDataFrame(
        [
            ("WHEAT", "2022-11-14T00:00:00Z", "Harvest forecasts are good this autumn", "x7", "ana", 2, 0, "farming"),
            ("WHEAT", "2022-11-17T18:30:00Z", "Export ban announced, silos stay full", "x8", None, 31, 12, "news"),
            ("WHEAT", "2022-11-20T23:59:59Z", "Nobody expects rain before December", "x9", "bo", 0, 5, "farming"),
        ],
        POST_DDL,
    )


#: (negative, neutral, positive) by the first word of a post.
STUB = {"harvest": (0.05, 0.3, 0.65), "export": (0.75, 0.2, 0.05), "nobody": (0.3, 0.4, 0.3)}


def stub():
    """A factory that travels to the workers by value."""
    table = dict(STUB)

    def factory():
        def predict(texts):
            return np.array([[table[t.split()[0]][k] for k in (1, 0, 2)] for t in texts])

        return ("neutral", "Negative", "POSITIVE"), predict

    return factory


def missing():
    raise ImportError("no such model")


def test_lexicon_backend_has_no_model_columns(spark):
    out = weekly_text_features(posts(spark), ["harvest", "silos"], 5)
    (row,) = out.collect()
    assert row["post_count"] == 3.0 and row["post_keyword_hits_sum"] == 2.0
    assert "post_lex_sentiment_mean" in out.columns
    assert not [c for c in out.columns if "model" in c]


def test_hybrid_backend_has_both(spark):
    (row,) = weekly_text_features(posts(spark), ["rain"], 5, backend="hybrid", factory=stub()).collect()
    scores = [positive - negative for negative, _, positive in STUB.values()]
    assert row["post_model_sentiment_mean"] == pytest.approx(sum(scores) / 3)
    assert row["post_model_sentiment_pos_share"] == pytest.approx(1 / 3)
    assert row["post_model_sentiment_neg_share"] == pytest.approx(1 / 3)
    assert row["post_model_sentiment_std"] == pytest.approx(np.std(scores, ddof=1))
    assert "post_lex_sentiment_mean" in row.asDict()


def test_backend_choice(spark):
    with pytest.raises(ValueError):
        S.with_sentiment(posts(spark), "tarot")
    with pytest.raises(ImportError):
        S.with_sentiment(posts(spark), "model", factory=missing)
    with pytest.warns(UserWarning):
        out = weekly_text_features(posts(spark), [], 5, backend=" Hybrid ", factory=missing)
    assert "post_lex_sentiment_mean" in out.columns and "post_model_sentiment_mean" not in out.columns
    model_only = weekly_text_features(posts(spark), [], 5, backend="model", factory=stub())
    assert "post_lex_sentiment_mean" not in model_only.columns


def test_model_scores_blank_texts_and_missing_labels(spark):
    def factory():
        return ("positive",), lambda texts: np.array([[1.0] if t == "[empty]" else [0.25] for t in texts])

    df = spark.createDataFrame([(1, " "), (2, "words"), (3, None)], "i int, clean_text string")
    rows = {r["i"]: r for r in S.with_model_sentiment(df, factory, batch_size=2).collect()}
    assert [rows[i]["model_positive"] for i in (1, 2, 3)] == [1.0, 0.25, 1.0]
    assert rows[2]["model_negative"] == 0.0 and rows[2]["model_sentiment"] == 0.25


LEXICON = {"good": 2.0, "bad": -2.0, "fine": 1.0}


def compound(total):
    return total / math.sqrt(total * total + 15)


CASES = {
    "good": 2.0,
    "nothing here": -0.0 * 2,
    "": 0.0,
    "good good bad": 2.0,
    "very good": 2.0 + 0.293,
    "very bad": -2.0 - 0.293,
    "slightly good": 2.0 - 0.293,
    "very odd good": 2.0 + 0.293 * 0.95,
    "very odd odd good": 2.0 + 0.293 * 0.9,
    "very odd odd odd good": 2.0,
    "not good": 2.0 * -0.74,
    "not so good": (2.0 + 0.293) * -0.74,
    "not odd odd odd good": 2.0,
    "good but bad": 2.0 * 0.5 - 2.0 * 1.5,
    "good but odd but bad": 2.0 * 0.5 - 2.0 * 1.5,
    "but fine": 1.5,
}


def test_polarity_rules(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "clean_text string")
    rows = S.with_lexicon_polarity(df, LEXICON).collect()
    for row in rows:
        assert row["lex_compound"] == pytest.approx(compound(CASES[row["clean_text"]])), row["clean_text"]


def test_joined_lexicon_gives_the_same_scores(spark):
    """No key, a null text, repeated rows, repeated and incomplete entries: both ways agree."""
    texts = [*CASES, None, "good but bad", "twice twice"]
    df = spark.createDataFrame([(None if i % 3 else i, t) for i, t in enumerate(texts)], "source_id int, clean_text string")
    rows = [*LEXICON.items(), ("twice", 1.0), ("twice", 2.0), ("blank", None), (None, 3.0)]
    table = spark.createDataFrame(rows, "token string, valence double")

    def scored(most):
        out = S.with_lexicon_polarity(df, table, max_literal=most)
        assert out.columns == [*df.columns, "lex_compound"]
        return sorted((str(r["source_id"]), str(r["clean_text"]), round(r["lex_compound"], 9)) for r in out.collect())

    inside, joined = scored(4), scored(3)
    assert inside == joined and len(joined) == len(texts)
    assert [score for _, text, score in joined if text == "twice twice"] == [round(compound(3.0), 9)]


def test_a_large_lexicon_stays_inside_the_row(spark):
    lexicon = {f"word{i}": (i % 9) - 4.0 for i in range(8000)}
    df = spark.createDataFrame([("word1 word2 other word7999",)], "clean_text string")
    total = sum(lexicon[w] for w in ("word1", "word2", "word7999"))
    assert S.with_lexicon_polarity(df, lexicon).first()["lex_compound"] == pytest.approx(compound(total))
    assert S.with_lexicon_polarity(df.where(F.lit(True)), {}).first()["lex_compound"] == 0.0
