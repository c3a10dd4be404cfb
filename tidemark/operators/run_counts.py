"""Counts of token runs per group of neighbouring rows, on packed integers instead of strings.

A task numbers the tokens of some whole groups, packs the group and the tokens of a run into one 64-bit number and sorts
these; a run takes eight bytes while it is counted, and becomes a string once, when its count is known. Where the
numbers of a run do not fit, its first part is replaced by its place among the different ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens after which the groups at hand are counted; a group is never cut.
TOKENS_AT_ONCE = 1_000_000
#: Counted runs in a batch, or a list, that goes back to Spark.
RUNS_AT_ONCE = 20_000
KEY_BITS = 64


def run_counter(group: Sequence[str], low: int, high: int, listed: bool = False) -> Callable:
    """For ``mapInArrow``: rows of (group, joined, cut, tokens) to rows of (group, term, n), or to lists (group, width, term, n).

    Rows of a group are neighbours, in order. A ``joined`` row goes on where the row of its group before it ends. Of a row
    with a ``cut`` above 0 only runs that begin in the first ``cut`` tokens and end behind them are counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, last = [], 0, None
        for batch in batches:
            keys = [batch.column(c).cast(pa.int64()) if pa.types.is_temporal(batch.schema.field(c).type) else batch.column(c) for c in group]
            keys = list(zip(*[k.to_pylist() for k in keys]))
            sizes = np.cumsum([0, *pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_pylist()])
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != last and tokens >= TOKENS_AT_ONCE:
                    yield from _counted(held, group, low, high, listed)
                    held, tokens = [], 0
                held.append((keys[start] != last, batch.slice(start, stop - start)))
                tokens, last, start = tokens + int(sizes[stop] - sizes[start]), keys[start], stop
        if held:
            yield from _counted(held, group, low, high, listed)

    return count


def _counted(held: list[tuple[bool, pa.RecordBatch]], group: Sequence[str], low: int, high: int, listed: bool) -> Iterator[pa.RecordBatch]:
    """The counts of some whole groups, from pieces of which each says whether it begins a group."""
    encoded = pa.concat_arrays([piece.column("tokens").flatten() for _, piece in held]).dictionary_encode()
    words = encoded.dictionary
    ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)
    del encoded
    if not len(ids):
        return
    heads = [piece for begins, piece in held if begins]
    names = [pa.concat_arrays([piece.column(c).slice(0, 1) for piece in heads]) for c in group]
    places = np.cumsum([begins for begins, _ in held]) - 1
    rows = [piece.num_rows for _, piece in held]
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(piece.column("tokens")), 0).to_numpy(zero_copy_only=False) for _, piece in held]).astype(np.int64)
    joined = np.concatenate([piece.column("joined").to_numpy(zero_copy_only=False) for _, piece in held]).astype(bool)
    cut = np.concatenate([piece.column("cut").to_numpy(zero_copy_only=False) for _, piece in held]).astype(np.int64)
    row_group = np.repeat(places, rows)
    # A row that is not joined, or begins a group, begins a stretch; runs stay within their stretch.
    begins = ~joined
    begins[0] = True
    begins[1:] |= row_group[1:] != row_group[:-1]
    ends = np.cumsum(sizes)
    first = np.flatnonzero(begins)
    stretch_end = np.repeat(ends[np.append(first[1:], len(ends)) - 1], np.diff(np.append(first, len(ends))))
    at = np.arange(len(ids))
    left = (np.repeat(stretch_end, sizes) - at).astype(np.int32)
    least = None
    if cut.any():
        over = np.repeat(np.where(cut > 0, ends - sizes + cut, 0), sizes) - at
        least = np.where(np.repeat(cut > 0, sizes), np.where(over > 0, over + 1, high + 1), 1)
    del at
    token_group = np.repeat(row_group, sizes).astype(np.uint64)
    for k, keys, counts, unpacked in _runs(ids, left, least, token_group, len(heads), len(words), low, high):
        for i in range(0, len(keys), RUNS_AT_ONCE):
            of, parts = unpacked(keys[i : i + RUNS_AT_ONCE])
            texts = [words.take(pa.array(part - np.uint64(1))) for part in parts]
            term = texts[0] if k == 1 else pc.binary_join_element_wise(*texts, " ")
            n = pa.array(counts[i : i + RUNS_AT_ONCE], pa.int64())
            if not listed:
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([*[c.take(of) for c in names], term, n], [*group, "term", "n"])
                continue
            if (of[1:] < of[:-1]).any():
                order = np.argsort(of, kind="stable")
                of, term, n = of[order], term.take(pa.array(order)), n.take(pa.array(order))
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            offsets = pa.array(np.append(first, len(of)), pa.int32())
            whose = pa.array(of[first])
            lists = [pa.ListArray.from_arrays(offsets, part) for part in (term, n)]
            yield pa.RecordBatch.from_arrays([*[c.take(whose) for c in names], pa.array(np.full(len(first), k), pa.int32()), *lists], [*group, "width", "term", "n"])


def _runs(
    ids: np.ndarray, left: np.ndarray, least: np.ndarray | None, token_group: np.ndarray, n_groups: int, n_words: int, low: int, high: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable]]:
    """For each length of a run: the different packed runs, how often each occurs, and what unpacks them."""
    bits = int(n_words).bit_length()
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    key, used, inside = token_group, int(n_groups - 1).bit_length(), 0
    tables: list[tuple[np.ndarray, int]] = []

    def unpacked(keys: np.ndarray, inside: int, tables: list) -> tuple[np.ndarray, list[np.ndarray]]:
        parts = []
        for _ in range(inside):
            parts.append(keys & mask)
            keys = keys >> shift
        if not tables:
            return keys, parts[::-1]
        table, before = tables[-1]
        of, earlier = unpacked(table[keys], before, tables[:-1])
        return of, earlier + parts[::-1]

    for k in range(1, min(high, len(ids)) + 1):
        if used + bits > KEY_BITS:
            ranked = pa.array(key).dictionary_encode()
            tables = [*tables, (ranked.dictionary.to_numpy(zero_copy_only=False), inside)]
            key, used, inside = ranked.indices.to_numpy(zero_copy_only=False).astype(np.uint64), int(len(ranked.dictionary) - 1).bit_length(), 0
        key = key << shift
        key[: len(ids) - (k - 1)] |= ids[k - 1 :]
        used, inside = used + bits, inside + 1
        if k < low:
            continue
        whole = left >= k
        if least is not None:
            whole &= least <= k
        found = np.sort(key[whole])
        if not len(found):
            continue
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        counts = np.diff(np.append(starts, len(found)))
        yield k, found[starts], counts, lambda keys, inside=inside, tables=tables: unpacked(keys, inside, tables)
