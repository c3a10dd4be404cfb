from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean_text, keyword_hits, word_tokens

TEXTS = [
    "Bitcoin looks STRONG!!", "see https://a.b/c?d=1 and www.x.org/y now", "  tabs\tand\nlines here  ",
    "100% sure: $BTC up +3.5 (not -2), @me #tag", "Straße Ñandú 日本語 emoji 😀 x_y", "", None, "http://only.url",
    "don't; won't", "a b\u0085c\x1cd", "é combining", "½ ² Ⅷ",
]


def is_space(c: str) -> bool:
    return c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c).startswith("Z")


def is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def expected_clean(text: str | None) -> str:
    """Character by character: a link runs to the next space, other characters stay or part two words."""
    text, out, at = (text or "").lower(), [], 0
    while at < len(text):
        start = next((len(p) for p in ("http://", "https://", "www.") if text.startswith(p, at)), 0)
        if start and at + start < len(text) and not is_space(text[at + start]):
            while at < len(text) and not is_space(text[at]):
                at += 1
            out.append(" ")
            continue
        c = text[at]
        out.append(c if is_word(c) or c in "#@.$%+-" else " ")
        at += 1
    return " ".join(part for part in "".join(out).split(" ") if part)


def test_clean_text_follows_unicode_word_and_space_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows = df.select("i", clean_text(F.col("text")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == {i: expected_clean(t) for i, t in enumerate(TEXTS)}


def test_keyword_hits_count_substrings_without_overlap(spark):
    df = spark.createDataFrame([("we belong to the long line", 1), ("aaaa", 2), ("", 3)], "t string, i int")
    got = {r["i"]: r["h"] for r in df.select("i", keyword_hits(F.col("t"), ["LONG", "aa"]).alias("h")).collect()}
    assert got == {1: 2, 2: 2, 3: 0}
    none = df.select(keyword_hits(F.col("t"), []).alias("h")).collect()
    assert {r["h"] for r in none} == {0}
    with pytest.raises(ValueError):
        keyword_hits(F.col("t"), ["ok", ""])


def test_word_tokens_match_the_usual_token_pattern(spark):
    texts = [t for t in (expected_clean(t) for t in TEXTS)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", "t", word_tokens(F.col("t")).alias("w")).collect():
        expected = re.findall(r"\b\w\w+\b", row["t"])
        assert Counter(row["w"]) == Counter(expected)
        assert row["w"] == expected
