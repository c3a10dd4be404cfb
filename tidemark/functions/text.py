"""Text columns as native expressions: no Python per row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes for Unicode word and space characters in Java patterns. The
# plain ranges come first because they decide most characters.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
WORD = r"a-z0-9\p{L}\p{N}_"
URL_PATTERN = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
GAP_PATTERN = rf"[^{WORD}#@.$%+-]+"
WORD_PATTERN = rf"[{WORD}]{{2,}}+"


def clean_text(text: Column) -> Column:
    """Lower case, no links, only word characters and ``# @ . $ % + -``, single spaces.

    A null text becomes an empty one. Dropped characters and spaces are one class, so that a
    single pass turns every run of them into one space. Links are sought only in texts that hold what each has.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    linked = F.contains(lowered, F.lit("://")) | F.contains(lowered, F.lit("www."))
    without_urls = F.when(linked, F.regexp_replace(lowered, URL_PATTERN, " ")).otherwise(lowered)
    return F.trim(F.regexp_replace(without_urls, GAP_PATTERN, " "))


def keyword_hits(text: Column, lexicon: Sequence[str]) -> Column:
    """Non-overlapping substring counts of every lexicon entry, summed ("long" hits "belong")."""
    words = [word.lower() for word in lexicon]
    if any(not word for word in words):
        raise ValueError("an empty keyword would match everywhere")
    counts = [
        (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))
        for word in words
    ]
    return reduce(add, counts, F.lit(0.0)).cast("long")


def outer_tokens(text: Column) -> tuple[Column, Column]:
    """First and last of the ``word_tokens``, without making the list; empty where there is none."""
    first = F.regexp_extract(text, WORD_PATTERN, 0)
    return first, F.reverse(F.regexp_extract(F.reverse(text), WORD_PATTERN, 0))


def word_tokens(text: Column) -> Column:
    """Runs of two or more word characters, in order."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
