"""Exact top-k by inner product as a Voronoi k-nearest-neighbour join.

Inner products become distances: a data vector x gets one more component sqrt(M^2 - |x|^2), M the
largest length, a query gets 0 there, and then the nearest data vector has the largest product.
Queries and data are grouped by their nearest pivot. From summaries of the cells (counts by distance
to the pivot, the farthest query) each query cell has a distance within which its k results must lie;
by the triangle inequality a data vector goes only to the query units whose bound it can meet. A unit
is a run of neighbouring query cells, and a large cell is split into several. Units are solved
locally, against blocks of their data, and the blocks' best k are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import keep
from tidemark.llm.vectors import best_k, bounded_sample, distances, matrix, read_vectors

#: Pivots are a bounded sample; queries of a unit and data vectors of a block bound what a task holds.
MOST_PIVOTS, UNIT_QUERIES, BLOCK_ROWS, BARS = 256, 512, 4096, 64


def _lift(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0))
    return np.concatenate([x, more[:, None]], axis=1)


def _placer(pivots: np.ndarray, width: int, longest: float, query: bool):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_lift(matrix(batch.column(1), width), longest, query), pivots)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["vec_id", "vector", "cell", "far"])

    return place


def _units(sizes: dict[int, int], between: np.ndarray) -> list[tuple[int, list[int], int]]:
    """(first unit, cells, number of units): neighbouring cells share a unit, large cells are split."""
    left, chain = set(sizes), []
    while left:
        at = min(left) if not chain else min(left, key=lambda c: (between[chain[-1], c], c))
        chain.append(at)
        left.remove(at)
    out, cells, held, number = [], [], 0, 0
    for cell in chain:
        if cells and held + sizes[cell] > UNIT_QUERIES:
            parts = -(-held // UNIT_QUERIES)
            out.append((number, cells, parts))
            number, cells, held = number + parts, [], 0
        cells.append(cell)
        held += sizes[cell]
    if cells:
        out.append((number, cells, -(-held // UNIT_QUERIES)))
    return out


def _bounds(bars: list, between: np.ndarray, farthest: dict[int, float], copies: dict[int, int], k: int) -> dict[int, float]:
    """For each query cell a distance within which every query of it has k data vectors besides its own.

    ``copies``: the most data rows under the id of one query of the cell, none of which is a candidate for it.
    """
    cell = np.array([b["cell"] for b in bars])
    top, count = np.array([b["top"] for b in bars]), np.array([b["n"] for b in bars])
    out = {}
    for c, reach in farthest.items():
        most = reach + between[c, cell] + top
        order = np.argsort(most, kind="stable")
        enough = np.flatnonzero(np.cumsum(count[order]) >= k + copies[c])
        out[c] = float(most[order][enough[0]]) if len(enough) else np.inf
    return out


def _sender(between: np.ndarray, farthest: dict[int, float], bound: dict[int, float], units: list, blocks: int):
    cells = np.array(sorted(farthest))
    reach, limit = np.array([farthest[c] for c in cells]), np.array([bound[c] for c in cells])
    slack = 1e-6 * (1 + between.max())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = between[np.ix_(own, cells)]
            least = np.abs(apart - far[:, None]) - reach
            need = least <= limit + slack
            block = (batch.column(0).to_numpy() % blocks).astype(np.int32)
            for first, members, parts in units:
                chosen = np.flatnonzero(need[:, np.isin(cells, members)].any(axis=1))
                if len(chosen):
                    at = pa.array(chosen)
                    for unit in range(first, first + parts):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(chosen), unit, np.int32)), pa.array(block[chosen]), batch.column(0).take(at), batch.column(1).take(at)],
                            ["unit", "block", "vec_id", "vector"],
                        )

    return send


def _solver(width: int, k: int):
    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        ids, own = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        x, q = matrix(data["vector"], width), matrix(queries["vector"], width)
        if len(x) and len(q) and width * np.abs(x).max() * np.abs(q).max() < 2.0**52:
            score = q @ x.T
        else:  # beyond exact doubles
            score = (q.astype(object) @ x.astype(object).T) if len(x) and len(q) else np.zeros((len(q), len(x)))
            score = np.array([[float(v) for v in r] for r in score]).reshape(len(q), len(x))
        row, col = best_k(np.where(own[:, None] == ids[None, :], np.inf, -score), ids, k)
        return pa.table({"query_id": own[row], "vec_id": ids[col], "score": score[row, col].astype(np.int64)})

    return solve


def top_products(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` the k largest integer products.

    Components become floor(scale * x). A vector that is null or has a null or non-finite component
    takes no part, nor does a row without id; a shorter vector counts as padded with zeros. A query's
    own id is no candidate. Ties go to the smaller id. Where a query id is repeated, its smallest
    vector asks; repeated data rows are candidates of their own. Fewer than k candidates are all
    returned; an empty table gives an empty result; other columns are ignored.
    """
    whole = read_vectors(df, id_column, vector_column).select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    data = keep(whole, "vectors")
    asking = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count("*").alias("copies"))
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(norm).alias("norm")).first()
    n, width, longest = facts["n"], facts["width"] or 0, float(facts["norm"] or 0) ** 0.5
    pivots = _lift(bounded_sample(data, int(min(MOST_PIVOTS, max(1, n**0.5))), width), longest, False)
    if not len(pivots):
        pivots = np.zeros((1, width + 1))
    placed_schema = "vec_id long, vector array<double>, cell int, far double"
    placed = keep(data.mapInArrow(_placer(pivots, width, longest, False), placed_schema), "placed")
    asked = keep(asking.select("vec_id", "vector").mapInArrow(_placer(pivots, width, longest, True), placed_schema), "asked")

    # Summaries: at most BARS rows a cell, and one row per query cell.
    step = 2 * longest / BARS or 1.0
    bar = F.floor(F.col("far") / step)
    bars = placed.groupBy("cell", bar.alias("bar")).agg(F.count("*").alias("n"), F.max("far").alias("top")).collect()
    cells = asked.join(asking.select("vec_id", "copies"), "vec_id").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("copies").alias("copies")).collect()
    between = distances(pivots, pivots)
    farthest = {r["cell"]: r["far"] for r in cells}
    units = _units({r["cell"]: r["n"] for r in cells}, between)
    bound = _bounds(bars, between, farthest, {r["cell"]: r["copies"] for r in cells}, k) if bars else {}

    blocks = max(1, -(-n // BLOCK_ROWS))
    sent = placed.mapInArrow(_sender(between, farthest, bound, units, blocks), "unit int, block int, vec_id long, vector array<double>")
    first = {c: (u, parts) for u, members, parts in units for c in members}
    lookup = F.create_map(*[F.lit(x) for c, (u, parts) in first.items() for x in (c, (u << 20) | parts)]) if first else F.create_map(F.lit(0), F.lit(1))
    code = F.element_at(lookup, F.col("cell"))
    unit = (F.shiftright(code, 20) + F.pmod(F.xxhash64("vec_id"), code.bitwiseAND((1 << 20) - 1))).cast("int")
    # A query goes to every block of its unit's data.
    spread = asked.select(unit.alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vector")
    solved = (
        spread.groupBy("unit", "block").cogroup(sent.groupBy("unit", "block"))
        .applyInArrow(_solver(width, k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
