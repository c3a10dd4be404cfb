"""Vectors in tables and in tasks: which rows count, bounded samples, matrices, and best-k picks with ties by id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, and every component finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def read_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of rows that can take part; rows without id are left out."""
    vector = F.col(vector_column).cast("array<double>")
    return df.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def bounded_sample(vectors: DataFrame, most: int, width: int) -> np.ndarray:
    """At most ``most`` vectors, chosen by hash; shorter ones padded with zeros."""
    rows = vectors.select("vector", F.xxhash64("vec_id").alias("place")).orderBy("place", "vector").limit(most).collect()
    return padded([r["vector"] for r in rows], width)


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of a matrix; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows of two small sets (one of them bounded)."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def best_k(keys: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest finite keys in each row, ties to the smaller id."""
    if not keys.size:
        return np.zeros(0, int), np.zeros(0, int)
    if keys.shape[1] > k:
        edge = np.partition(keys, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero((keys <= edge) & np.isfinite(keys))
    else:
        row, col = np.nonzero(np.isfinite(keys))
    order = np.lexsort((ids[col], keys[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]
