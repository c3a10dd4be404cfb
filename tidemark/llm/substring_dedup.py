"""Remove passages that occur earlier in the corpus, by an exact index of windows.

There is no relative Lempel-Ziv factoring: no reference block is parsed against, and no factor has a
reference, a position or a length in it. Instead the first occurrence of each window is looked up. The
index is built in two steps, so that it stays small. First windows are reduced to their minimiser, the
smallest hash of ``GRAM`` consecutive words, which neighbouring windows share; a window that occurs
twice brings its minimiser twice, so windows whose minimiser is unique are new text and never enter the
index. Then the remaining windows are grouped by two 64-bit hashes, with their first occurrence. In each
document, runs of windows that occur earlier become duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import NOT_SPACE, U64, Words, as_bytes, keep, mix, pick, pieces, rolling

#: Words of the grams from which a window's minimiser is taken.
GRAM = 6


def _sliding(values: np.ndarray, span: int, pick_one) -> np.ndarray:
    """``pick_one`` (minimum or maximum) over every ``span`` neighbours."""
    done = 1
    while done * 2 <= span:
        values = pick_one(values[: len(values) - done], values[done:])
        done *= 2
    rest = span - done
    return pick_one(values[: len(values) - rest], values[rest:]) if rest else values


def _minimisers(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest gram hash inside each window of ``width`` words, and the gram hashes."""
    gram = min(GRAM, width)
    grams = rolling(hashes, gram, stream=31)
    return _sliding(grams, width - gram + 1, np.minimum), grams


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and which windows lie inside one row."""
    hashes = words.hashes(lower=False)
    count = max(0, len(hashes) - width + 1)
    return hashes, (words.row[:count] == words.row[width - 1 :] if count else np.zeros(0, bool))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    body, bounds = as_bytes(batch.column(column))
    for first, last in pieces(bounds):
        yield first, last, Words(body[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], NOT_SPACE)


def _runs(width: int):
    """(low, doc_id) for each place that is the minimiser of some window; equal windows have two such places."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, words in _parts(batch, 1):
                hashes, whole = _windows(words, width)
                if not len(whole):
                    continue
                lows, grams = _minimisers(hashes, width)
                lows, edge = np.where(whole, lows, U64(0)), np.zeros(len(grams) - len(lows), U64)
                chosen = _sliding(np.concatenate([edge, lows, edge]), len(edge) + 1, np.maximum) == grams
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[chosen].view(np.int64)), pa.array(ids[first:][words.row[: len(grams)][chosen]].astype(np.int64))], ["low", "doc_id"]
                )

    return make


def _listed(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column for some rows, and the row (from 0) of each."""
    part = column.slice(first, last - first)
    sizes = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(last - first), sizes)


def _known(rows: np.ndarray, values: np.ndarray, in_rows: np.ndarray, in_values: np.ndarray) -> np.ndarray:
    """Which (row, value) pairs are among the listed ones."""
    if not len(in_rows):
        return np.zeros(len(rows), bool)
    listed = np.sort(mix(in_values.astype(np.int64).view(U64) ^ mix(in_rows.astype(U64) + U64(1))))
    asked = mix(values.astype(np.int64, copy=False).view(U64) ^ mix(rows.astype(U64) + U64(1)))
    return listed[np.minimum(np.searchsorted(listed, asked), len(listed) - 1)] == asked


def _candidates(words: Words, width: int, lows_in: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of windows whose minimiser occurs more than once, and the word hashes."""
    hashes, whole = _windows(words, width)
    if not len(whole):
        return np.zeros(0, np.int64), hashes
    found = _known(words.row[: len(whole)], _minimisers(hashes, width)[0].view(np.int64), lows_in[1], lows_in[0])
    return np.flatnonzero(whole & found), hashes


def _placed(turn: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A start and, before it, the turn of its text among those of one id, as one number."""
    return (turn.astype(np.int64) << 32) + start


def _indexed(width: int):
    """(key1, key2, doc_id, start) of every candidate window."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, words in _parts(batch, 1):
                at, hashes = _candidates(words, width, _listed(batch.column(2), first, last))
                if not len(at):
                    continue
                row = words.row[at]
                turns = batch.column(3).to_numpy(zero_copy_only=False)[first:]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rolling(hashes, width, stream=32)[at].view(np.int64)),
                        pa.array(rolling(mix(hashes), width, stream=33)[at].view(np.int64)),
                        pa.array(ids[first:][row].astype(np.int64)),
                        pa.array(_placed(turns[row], at - words.first[row])),
                    ],
                    ["key1", "key2", "doc_id", "start"],
                )

    return make


def _factors(earlier: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in words) of the maximal runs of windows found earlier."""
    steps = np.diff(np.concatenate([[0], earlier.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) + width - 1


def _parser(width: int):
    """Kept text, counts and spans of every document."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in _parts(batch, 1):
                at, _ = _candidates(words, width, _listed(batch.column(2), first, last))
                new, new_rows = _listed(batch.column(3), first, last)
                turns = batch.column(4).to_numpy(zero_copy_only=False)[first:]
                starts = _placed(turns[words.row[at]], at - words.first[words.row[at]])
                earlier = np.zeros(len(words.starts) + 1, bool)
                earlier[at[~_known(words.row[at], starts, new_rows, new)]] = True
                begins, stops = _factors(earlier, width)
                # A run of windows never leaves its row, as windows across rows are no candidates.
                change = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(change, begins, 1)
                np.add.at(change, stops, -1)
                removed = np.cumsum(change)[:-1] > 0
                lost = np.bincount(words.row[removed], minlength=last - first)
                texts, spans, marks = [], [[] for _ in range(last - first)], []
                for b, e in zip(begins.tolist(), stops.tolist()):
                    row = int(words.row[b])
                    spans[row].append({"start": b - int(words.first[row]), "end": e - int(words.first[row])})
                body = words.body.tobytes()
                for row in range(last - first):
                    lo, hi = int(words.first[row]), int(words.first[row + 1])
                    stay = np.flatnonzero(~removed[lo:hi]) + lo
                    text = b" ".join([body[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())])
                    texts.append(text.decode("utf-8", "replace"))
                    marks.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(words.counts.astype(np.int64)), pa.array(lost.astype(np.int64)),
                        pa.array(texts, pa.string()), pa.array(marks, pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"],
                )

    return parse


def remove_repeats(docs: DataFrame, width: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 and spans (start, end in words) per document.

    A window is ``width`` consecutive words (runs without white space, unchanged). Every word covered by
    a window whose words also start earlier (smaller doc_id, or same document and earlier place) goes;
    windows are judged on the input. Null and blank texts have no words. Rows
    repeated with one id and text are one document, returned as often as given; of several texts under one
    id, each is a document of its own, the one with the smaller 64-bit hash the earlier. A row without id is
    returned whole and is no reference. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.where("doc_id is not null")
    lows = named.mapInArrow(_runs(width), "low long, doc_id long")
    twice = lows.groupBy("low").agg(F.count("*").alias("often")).where("often > 1").select("low")
    repeated = keep(lows.join(twice, "low").groupBy("doc_id").agg(F.collect_set("low").alias("lows")), "repeated")
    several = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if several.isEmpty():
        turned = rows.withColumn("turn", F.lit(0))
    else:
        marks = named.join(several, "doc_id").select("doc_id", F.xxhash64("text").alias("mark")).distinct()
        turns = keep(marks.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("mark")) - 1).where("turn > 0"), "turns")
        turned = rows.withColumn("mark", F.xxhash64("text")).join(turns, ["doc_id", "mark"], "left").select("doc_id", "text", F.coalesce("turn", F.lit(0)).alias("turn"))
    windows = turned.join(repeated, "doc_id").select("doc_id", "text", "lows", "turn").mapInArrow(_indexed(width), "key1 long, key2 long, doc_id long, start long")
    first = windows.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    firsts = keep(first.groupBy("first.doc_id").agg(F.collect_list("first.start").alias("firsts")), "firsts")
    known = repeated.join(firsts, "doc_id", "left")
    return turned.join(known, "doc_id", "left").select("doc_id", "text", "lows", "firsts", "turn").mapInArrow(
        _parser(width), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    )
