"""Rare units are joined once for all documents; edges of a unit reach the fold as they are made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import pieces
from tidemark.llm.queries import PIECES


def test_rare_units_are_gathered_once(spark, monkeypatch):
    names, plain = [], pieces.keep
    monkeypatch.setattr(pieces, "keep", lambda df, name, **more: names.append(name) or plain(df, name, **more))
    rows = [(k % 30, f"text number {k} with qx{k}zw and été {'ab' * k}") for k in range(40)] + [(None, "no id here"), (None, None), (7, ""), (8, "x" * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(pieces.encode(docs, PIECES).collect(), key=repr)
    assert names == ["units", "segmented", "encoded"]
    names.clear()
    got = pieces.encode(docs, PIECES, common=5)
    assert names == ["units", "segmented", "extra"] + ["encoded"] * pieces.SLICES
    assert sorted(got.collect(), key=repr) == want
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in pieces.decode(got, PIECES).collect()) == sorted((i is None, i or 0, t or "") for i, t in rows)


def test_edges_of_a_unit_stay_together_over_batches(monkeypatch):
    monkeypatch.setattr(pieces, "EDGES", 4)
    keys = [3, 3, 3, 1, 2, 2, 2, 2, 2, 2, 2, 9, 4, 4]
    first = [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]
    table = pa.table({"key": pa.array(keys, pa.int64()), "part": [f"u{k}" if f else None for k, f in zip(keys, first)], "n": pa.array(keys, pa.int64()), "edge": pa.array(range(len(keys)), pa.int64())})
    for rows in (1, 2, 3, 5, 14):
        units = []
        for key, part, n, sizes, edges in pieces._units_of_edges(iter(table.to_batches(rows))):
            ends = np.cumsum(sizes)
            units += [(k, p, edges[e - s : e].tolist()) for k, p, s, e in zip(key.to_pylist(), part.to_pylist(), sizes.tolist(), ends.tolist())]
        assert units == [(3, "u3", [0, 1, 2]), (1, "u1", [3]), (2, "u2", list(range(4, 11))), (9, "u9", [11]), (4, "u4", [12, 13])]
    with pytest.raises(ValueError):
        list(pieces._units_of_edges(iter(pa.concat_tables([table, table]).to_batches(3))))


def test_distinct_hashes_with_a_place_of_each():
    values = np.array([5, 2, 5, 5, 9, 2], dtype=np.uint64)
    own, at, n = pieces._distinct(values)
    assert own.tolist() == [2, 5, 9] and n.tolist() == [2, 3, 1] and (values[at] == own).all()
    assert [len(x) for x in pieces._distinct(values[:0])] == [0, 0, 0]
