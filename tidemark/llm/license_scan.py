"""Licence scan with a positional index of rare licence words, as column expressions only.

The templates (short phrases and opening sentences of licence notices) form an index from word to
(template, place). One pass counts in how many documents each licence word occurs; the driver sees
one number per licence word. Each template is looked up by its rarest words, the ones with the highest
inverse document frequency. A second pass keeps each file's licence words with their positions, turns
a rare word at p that stands at q of a template into a start p - q, intersects the postings of the
template's rare words at that start, and verifies the template's mandatory key phrase word by word.
No row leaves its task in the second pass, so hot sources and long texts move nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import pick

#: Phrases that name a licence, and their labels. All their words are mandatory.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Further phrases of public licence notices; a label, the notice's words, the words that must stand there.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "bsd license", "bsd license"),
    ("apache", "licensed under the apache license version 2 0", "the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
)
#: Rare words by which a template is looked up, and the share of them that has to stand in place.
ANCHORS, SHARE = 4, 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def file_words(text: Column) -> Column:
    """Words of a whole text in order, as written: runs of ASCII letters, digits and any character above U+007F."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def templates(base: Sequence[tuple[str, str]] = BASE_PHRASES, notices: Sequence[tuple[str, str, str]] = NOTICES) -> list[tuple[str, list[str], int, list[str], bool]]:
    """(label, words, place of the key phrase, key phrase, whether it is a base phrase)."""
    out = [(label, phrase.split(), 0, phrase.split(), True) for phrase, label in base]
    for label, notice, key in notices:
        words, must = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        out.append((label, words, at, must, False))
    return out


def _at(words: Column, place: Column) -> Column:
    return F.lower(F.get(words, place))


def document_frequencies(rows: DataFrame, vocabulary: Sequence[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each licence word occurs; one row per word reaches the driver."""
    known = F.array_distinct(F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*vocabulary)))
    counted = rows.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}
    return found, found.pop("", 0)


def _anchors(words: Sequence[str], frequency: Mapping[str, int], documents: int) -> list[tuple[int, str]]:
    """The template's rarest words among those that occur at all, and their places; ties by place."""
    idf = {w: math.log((1 + documents) / (1 + frequency[w])) for w in words if frequency.get(w)}
    return sorted(sorted(((q, w) for q, w in enumerate(words) if w in idf), key=lambda p: (-idf[p[1]], p[0]))[:ANCHORS])


def _starts(words: Column, hits: Column, anchors: Sequence[tuple[int, str]]) -> Column:
    """Starts proposed by the rare words, as far as enough of them agree."""
    def by_word(q: int, w: str) -> Column:
        return F.transform(F.filter(hits, lambda h: h["word"] == w), lambda h: h["place"] - q)

    proposed = F.array_distinct(F.flatten(F.array(*[by_word(q, w) for q, w in anchors])))
    wanted = math.ceil(SHARE * len(anchors))

    def enough(start: Column) -> Column:
        agree = sum(((start + q >= 0) & (_at(words, start + q) == w)).cast("int") for q, w in anchors)
        return F.coalesce(agree, F.lit(0)) >= wanted

    return F.filter(proposed, enough) if len(anchors) > 1 else proposed


def _verified(words: Column, starts: Column, at: int, must: Sequence[str]) -> Column:
    def stands(start: Column) -> Column:
        test = start + at >= 0
        for j, word in enumerate(must):
            test = test & (_at(words, start + (at + j)) == word)
        return F.coalesce(test, F.lit(False))

    return F.filter(starts, stands)


def scan_licenses(docs: DataFrame, base=BASE_PHRASES, notices=NOTICES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches per row.

    first_word and last_word are the smallest and largest start of a base phrase (words from 0), null
    without one. labels also has those of the notices; matches lists (label, start, share) for every
    verified place, share being the part of the template's words that stand there, and score is the
    largest share (0 without a match). A null text counts as empty; rows without id and repeated rows
    are scanned like others; other columns are ignored; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).select("doc_id", file_words(F.col("text").cast("string")).alias("words"))
    known = templates(base, notices)
    vocabulary = sorted({w for _, words, _, _, _ in known for w in words})
    frequency, documents = document_frequencies(rows, vocabulary)

    words = F.col("words")
    # A base phrase is looked up by its single rarest word: every place of it is a candidate.
    postings = []
    for label, whole, at, must, is_base in known:
        anchors = _anchors(whole, frequency, documents)
        if not all(frequency.get(w) for w in must):
            continue  # a mandatory word occurs in no file
        postings.append((label, whole, at, must, is_base, sorted(anchors, key=lambda p: (frequency.get(p[1], 0), p[0]))[:1] if is_base else anchors))
    rare = sorted({w for *_, anchors in postings for _, w in anchors})
    rare = rare or [""]
    hits = F.filter(F.transform(words, lambda w, i: F.struct(F.lower(w).alias("word"), i.alias("place"))), lambda h: h["word"].isin(*rare))
    none = F.array().cast("array<struct<word:string,place:int>>")
    # Most files have no rare licence word: they never build positions.
    hit = rows.select("doc_id", "words", F.when(F.exists(words, lambda w: F.lower(w).isin(*rare)), hits).otherwise(none).alias("hits"))

    def matches(label: str, whole: Sequence[str], at: int, must: Sequence[str], is_base: bool, anchors: Sequence[tuple[int, str]]) -> Column:
        def entry(start: Column) -> Column:
            agree = sum(F.coalesce(((start + q >= 0) & (_at(words, start + q) == w)).cast("int"), F.lit(0)) for q, w in enumerate(whole))
            return F.struct(F.lit(label).alias("label"), start.alias("start"), (agree / F.lit(float(len(whole)))).alias("share"), F.lit(is_base).alias("base"))

        return F.transform(_verified(words, _starts(words, F.col("hits"), anchors), at, must), entry)

    found = [matches(*posting) for posting in postings]
    empty = F.array().cast("array<struct<label:string,start:int,share:double,base:boolean>>")
    matched = hit.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        (F.when(F.size("hits") > 0, F.array_sort(F.flatten(F.array(*found)))).otherwise(empty) if found else empty).alias("matches"),
    )
    places = matched.withColumn("places", F.transform(F.filter("matches", lambda m: m["base"]), lambda m: m["start"]))

    def labels(some: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda m: m["label"]))), ",")

    return places.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        labels(F.filter("matches", lambda m: m["base"])).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"), "matches",
    )
