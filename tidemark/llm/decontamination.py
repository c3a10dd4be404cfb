"""Benchmark decontamination: a broadcast hash set of the items' word windows, looked up in every document window.

Words are runs of letters, digits and other signs beyond ASCII, with A-Z lowered. The windows of the items
become a table of distinct texts with the items that hold them. Its hashes, words and items are broadcast
in blocks of bounded size: with one block the documents are scanned once, with a large benchmark once per
block, in one chain of tasks without a shuffle. A task hashes all windows of a batch of texts at once, asks a
small bit table, then the sorted hashes, and compares the words of what is left, so a hit is certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import U64, Words, as_bytes, fresh, keep, pick, pieces, rolling, small, word_table

#: Bytes that separate words (letters A-Z are lowered first).
IS_WORD = word_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most (window, item) pairs and bytes of window texts that are broadcast at once.
BLOCK_PAIRS = 1 << 19
BLOCK_BYTES = 1 << 25
#: Size of the bit table and hits that are compared at once.
BITS = 1 << 20
COMPARED = 1 << 15
STREAM = 41

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)), T.StructField("kept", T.StringType()),
])
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32


def item_windows(benchmark: DataFrame, width: int = 10, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(width, window, items): each distinct window text with the sorted ids, as strings, of the items that hold it.

    An item with fewer than ``width`` words, but not none, is one window. Null texts have no window; items
    without id give windows that name no item. Items repeated under one id count once.
    """
    items = pick(benchmark, item=id_column, text=text_column).select(
        F.col("item").cast("string").alias("item"), F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(WORD_PATTERN), 0).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    cut = items.select("item", F.least(F.size("words"), F.lit(width)).alias("width"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, width), " "))).alias("window"))
    return cut.groupBy("width", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Index:
    """Windows of one block: per width the sorted hashes, and the words and items of each window."""

    def __init__(self, rows: pa.Table) -> None:
        self.parts = []
        widths = rows.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            part = rows.filter(pa.array(widths == width)).combine_chunks()
            body, bounds = as_bytes(part.column("window").combine_chunks())
            words = Words(body, bounds, IS_WORD)
            keys = rolling(words.hashes(lower=True), width, STREAM)[words.first[:-1]]
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(BITS, bool)
            bits[(keys & U64(BITS - 1)).astype(np.int64)] = True
            # Neighbouring windows mostly share their items: each set is held once.
            sets: dict[tuple, int] = {}
            which = np.array([sets.setdefault(tuple(i), len(sets)) for i in part.column("items").to_pylist()])[order]
            first = words.first[:-1][order][:, None] + np.arange(width)
            self.parts.append((width, keys[order], bits, body, words.starts[first], (words.ends - words.starts)[first], which, list(sets)))

    def find(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple]]]:
        """Per width: the first words of the windows found, the number of each one's set of items, and those sets."""
        lengths = words.ends - words.starts
        for width, keys, bits, body, starts, sizes, which, sets in self.parts:
            asked = rolling(hashes, width, STREAM)
            at = np.flatnonzero(bits[(asked & U64(BITS - 1)).astype(np.int64)])
            at = at[words.row[at] == words.row[at + width - 1]]
            place = np.searchsorted(keys, asked[at])
            # Different windows with one hash lie side by side: look at each of them.
            while len(at):
                inside = place < len(keys)
                at, place = at[inside], place[inside]
                same = keys[place] == asked[at]
                at, place = at[same], place[same]
                good = np.zeros(len(at), bool)
                for low in range(0, len(at), COMPARED):
                    part = slice(low, low + COMPARED)
                    good[part] = _equal(words, lengths, at[part], width, body, starts[place[part]], sizes[place[part]])
                yield width, at[good], which[place[good]], sets
                at, place = at[~good], place[~good] + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte places of all given words, one after the other."""
    starts, sizes = starts.ravel(), sizes.ravel()
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _equal(words: Words, lengths: np.ndarray, at: np.ndarray, width: int, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the words from each place are those of the window it is held against."""
    mine = at[:, None] + np.arange(width)
    good = (lengths[mine] == sizes).all(axis=1)
    some = np.flatnonzero(good)
    if len(some):
        left = _LOWERED[words.body[_spread(words.starts[mine[some]], sizes[some])]]
        differ = left != body[_spread(starts[some], sizes[some])]
        total = sizes[some].sum(axis=1)
        good[some] = np.add.reduceat(differ.astype(np.int64), np.cumsum(total) - total) == 0
    return good


def _scanner(payload, text_at: int, found_at: int | None, with_kept: bool):
    """Adds (or extends) the ``found`` column of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = payload.value
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
        for batch in small(batches):
            texts = batch.column(text_at)
            body, bounds = as_bytes(texts)
            before = batch.column(found_at).to_pylist() if found_at is not None else None
            found = []
            for first, last in pieces(bounds):
                words = Words(body[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], IS_WORD)
                rows = last - first
                change = np.zeros(len(words.starts) + 1, np.int64)
                held: list[set] = [set() for _ in range(rows)]
                if before is not None:
                    for row, old in enumerate(before[first:last]):
                        held[row].update(old["items"])
                        for span in old["spans"]:
                            change[words.first[row] + span["start"]] += 1
                            change[words.first[row] + span["end"]] -= 1
                for width, at, which, sets in index.find(words, words.hashes(lower=True)):
                    np.add.at(change, at, 1)
                    np.add.at(change, at + width, -1)
                    pairs = np.unique(words.row[at] * np.int64(len(sets)) + which)
                    for row, one in zip((pairs // len(sets)).tolist(), (pairs % len(sets)).tolist()):
                        held[row].update(sets[one])
                hit = np.cumsum(change)[:-1] > 0
                # A run of hit words is cut where a row begins.
                begins, stops = hit.copy(), hit.copy()
                begins[1:] &= ~hit[:-1] | (words.row[1:] != words.row[:-1])
                stops[:-1] &= ~hit[1:] | (words.row[1:] != words.row[:-1])
                begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
                spans: list[list] = [[] for _ in range(rows)]
                cuts: list[list] = [[] for _ in range(rows)]
                for b, e in zip(begins.tolist(), stops.tolist()):
                    row = int(words.row[b])
                    spans[row].append({"start": b - int(words.first[row]), "end": e + 1 - int(words.first[row])})
                    cuts[row].append((int(words.starts[b]), int(words.ends[e])))
                counts = np.bincount(words.row[hit], minlength=rows)
                for row in range(rows):
                    kept = None
                    if with_kept and texts[first + row].is_valid:
                        low, parts = int(bounds[first + row] - bounds[first]), []
                        for start, end in cuts[row]:
                            parts.append(words.body[low:start].tobytes())
                            low = end
                        parts.append(words.body[low : int(bounds[first + row + 1] - bounds[first])].tobytes())
                        kept = b"".join(parts).decode("utf-8", "replace")
                    found.append({"n_words": int(words.counts[row]), "n_hit": int(counts[row]), "items": sorted(held[row]), "spans": spans[row], "kept": kept})
            columns = [c for i, c in enumerate(batch.columns) if i != found_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != found_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*names, "found"])

    return scan


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, text_column: str, item_column: str, item_text_column: str, with_kept: bool,
             block_pairs: int = BLOCK_PAIRS) -> tuple[DataFrame, str]:
    spark = docs.sparkSession
    windows = keep(item_windows(benchmark, width, item_column, item_text_column), "windows")
    size = windows.agg(F.sum(F.greatest(F.size("items"), F.lit(1))).alias("pairs"), F.sum(F.octet_length("window")).alias("bytes")).first()
    blocks = max(1, math.ceil((size["pairs"] or 0) / block_pairs), math.ceil((size["bytes"] or 0) / BLOCK_BYTES))
    column = fresh(docs, "found")
    at = [c.lower() for c in docs.columns].index(text_column.lower())
    out = docs.withColumn(text_column, F.col(text_column).cast("string"))
    schema = T.StructType([*out.schema.fields, T.StructField(column, FOUND)])
    for block in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        payload = spark.sparkContext.broadcast(Index(part.toArrow()))
        out = out.mapInArrow(_scanner(payload, at, len(docs.columns) if block else None, with_kept and block == blocks - 1), schema)
    return out, column


def scan_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), spans (start, end in words) and contaminated per row of ``docs``.

    A word is hit where it lies in an occurrence of an item's window of ``width`` words (of a shorter item: all
    its words). Null and wordless texts have no words and no hit; repeated rows and ids stay rows of their
    own; items without id hit, but are not listed. Empty tables on either side give no row or no hit.
    """
    found, column = _scanned(pick(docs, doc_id=id_column, text=text_column), benchmark, width, "text", item_column, item_text_column, False, block_pairs)
    return found.select("doc_id", f"{column}.n_words", f"{column}.n_hit", f"{column}.items", f"{column}.spans", (F.col(f"{column}.n_hit") > 0).alias("contaminated"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, by: str = "spans", width: int = 10, text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", most_hit_share: float = 0.0,
) -> DataFrame:
    """``docs`` without benchmark passages, with all their columns.

    ``by="spans"`` cuts each run of hit words out of the text, from the first one's first character to the last
    one's last; ``by="documents"`` leaves out documents with more than ``most_hit_share`` of their words
    hit. Null texts stay null, and rows without a hit stay as they are.
    """
    if by not in ("spans", "documents"):
        raise ValueError(f"by has to be spans or documents, not {by!r}")
    found, column = _scanned(docs, benchmark, width, text_column, item_column, item_text_column, by == "spans")
    if by == "spans":
        return found.withColumn(text_column, F.col(f"{column}.kept")).select(*docs.columns)
    return found.where(F.col(f"{column}.n_hit") <= F.lit(most_hit_share) * F.col(f"{column}.n_words")).select(*docs.columns)


def items_digest(items: Sequence[str] | str = "items"):
    """Lowercase hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
