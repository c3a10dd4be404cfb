"""Helpers of the operators: tables in the shared folder, column selection, and word arithmetic in numpy.

A batch of texts is treated as one byte array with document offsets. Words are found and hashed for
the whole array at once, so Python never loops over words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once inside a task (a longer document is a piece of its own).
PIECE_BYTES = 2_000_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, as in tests, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="tidemark-llm-")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for a few steps; what was set before comes back."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Shuffle files go when the step that wrote them is done, not when the driver happens to collect its garbage.
STEPWISE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that other columns cannot clash."""
    return df.select(*[df[source].alias(target) for target, source in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(count: int, stream: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(stream * 0xD1342543DE82EF95 & (1 << 64) - 1))


def powers(base: int, count: int) -> np.ndarray:
    values = np.full(count, base & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    if count:
        values[0] = 1
    return np.multiply.accumulate(values)


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer stretch turns up."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=U64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(self.up):
            size = max(count, 1 << 16)
            up, down = powers(_BASE, size), powers(_BASE_INVERSE, size)
            if size > 8 * PIECE_BYTES:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


POWERS = Powers()


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows; a null counts as an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a worker's copies of texts stay small; unused memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def pieces(bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; every row is in exactly one."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_table(separators: Sequence[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Fixed values of the operators' word rules: white space is U+0020 and U+0009 to U+000D.
NOT_SPACE = word_table([0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_VALUES = seeds(256, 1)


class Words:
    """The words of some rows: ``starts`` and ``ends`` in bytes, ``row`` of each, ``first`` word of each row."""

    def __init__(self, body: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> None:
        inside = is_word[body]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(body):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = bounds[(bounds > 0) & (bounds < len(body))]
            before[edges] = False
            after[edges - 1] = False
        self.body = body
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(bounds) - 1), self.counts)
        self.values = np.where(is_word, _BYTE_VALUES, U64(0))

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of every word, by a polynomial over its bytes."""
        out = np.empty(len(self.starts), dtype=U64)
        values = self.values[_LOWER] if lower else self.values
        first, total = 0, len(self.starts)
        while first < total:
            last = int(np.searchsorted(self.ends, self.starts[first] + (1 << 18), side="right"))
            last = max(last, first + 1)
            low = self.starts[first]
            at = self.starts[first:last] - low
            up, down = POWERS.upto(int(self.ends[last - 1] - low))
            terms = values[self.body[low : self.ends[last - 1]]]
            terms *= up[: len(terms)]
            out[first:last] = np.add.reduceat(terms, at) * down[at]
            first = last
        return mix(out ^ (self.ends - self.starts).astype(U64))


def rolling(hashes: np.ndarray, width: int, stream: int = 2) -> np.ndarray:
    """A hash of every ``width`` consecutive values; only those inside one row mean anything."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    factors = seeds(width, stream) | U64(1)
    out = np.zeros(count, dtype=U64)
    for j in range(width):
        out += hashes[j : j + count] * factors[j]
    return mix(out)
