from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import run_counts as R
from tidemark.operators import terms as T

SCHEMA = "asset string, week_start timestamp, created_utc timestamp, source_id string, clean_text string"
POSTS = [
    ("A", 1, 3, "p3", "ab cd ab"), ("A", 1, 1, "p1", "ab ab ef gh"), ("A", 1, 2, None, "ab"), ("A", 1, 2, "p2", "x ?"), ("A", 1, 4, "p4", None),
    ("A", 1, 5, "p5", "cd cd cd"), ("A", 1, 5, "p5", "cd cd cd"), ("A", 8, 8, "p1", "ef"), ("B", 1, 1, "p1", "ef gh"), ("B", 1, 2, "p2", "ab cd"), ("B", 8, 9, "p9", "x"),
]


def table(spark):
    rows = spark.createDataFrame([(a, f"2024-01-{w:02d}", f"2024-01-{d:02d}", s, t) for a, w, d, s, t in POSTS], "asset string, week_start string, created_utc string, source_id string, clean_text string")
    return rows.withColumns({"week_start": F.to_timestamp("week_start"), "created_utc": F.to_timestamp("created_utc")})


def by_hand(low, high):
    words, out = {}, Counter()
    for a, w, _, _, t in sorted(POSTS, key=lambda p: (p[:3], p[3] or "")):
        words.setdefault((a, w), []).extend(x for x in (t or "").split() if len(x) > 1)
    for cell, all_ in words.items():
        for k in range(low, high + 1):
            out.update((*cell, " ".join(all_[i : i + k])) for i in range(len(all_) - k + 1))
    return out


@pytest.mark.parametrize("low, high", [(1, 2), (1, 4), (3, 3), (2, 6)])
def test_runs_of_whole_and_of_dealt_cells(spark, low, high):
    df, expected = table(spark), by_hand(low, high)
    for chars in (T.CELL_CHARS, 12, 1):
        found = T.post_terms(df, (low, high), cell_chars=chars).collect()
        assert Counter({(r["asset"], r["week_start"].day, r["term"]): r["n"] for r in found}) == expected and len(found) == len(expected)
        lists = T.post_terms(df, (low, high), cell_chars=chars, listed=True).collect()
        rows = [((r["asset"], r["week_start"].day, t), n, r["width"]) for r in lists for t, n in zip(r["term"], r["n"], strict=True)]
        assert Counter({key: n for key, n, _ in rows}) == expected and len(rows) == len(expected)
        assert all(width == key[2].count(" ") + 1 for key, _, width in rows)


def test_long_runs_meet_one_shuffle_and_no_rows_of_strings_before_they_are_counted(spark):
    plan = T.post_terms(table(spark), (1, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Generate", "Window", "Aggregate"))


@pytest.mark.parametrize("bits", [64, 9, 6])
def test_packed_runs_equal_strings_whatever_fits_into_a_number(monkeypatch, bits):
    monkeypatch.setattr(R, "KEY_BITS", bits)
    monkeypatch.setattr(R, "TOKENS_AT_ONCE", 5)
    monkeypatch.setattr(R, "RUNS_AT_ONCE", 3)
    posts = [("a", True, 0, "k l m k l".split()), ("a", True, 0, []), ("a", True, 0, ["m", "k"]), ("b", True, 0, None), ("b", False, 0, "k l k".split()), ("b", False, 0, ["l"]),
             ("b", False, 2, "m k l m".split()), ("c", True, 0, "n o n".split()), ("d", True, 0, ["n"]), ("d", True, 0, "o n o p".split())]
    stretches = [("a", 0, "k l m k l m k".split()), ("b", 0, "k l k".split()), ("b", 0, ["l"]), ("b", 2, "m k l m".split()), ("c", 0, "n o n".split()), ("d", 0, "n o n o p".split())]
    expected = Counter()
    for group, cut, words in stretches:
        for k in range(1, 5):
            expected.update((group, " ".join(words[i : i + k])) for i in range(len(words) - k + 1) if not cut or i < cut < i + k)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x) for x in ([p[0] for p in posts], [p[1] for p in posts])] + [pa.array([p[2] for p in posts], pa.int32()), pa.array([p[3] for p in posts], pa.list_(pa.string()))],
        ["group", "joined", "cut", "tokens"],
    )
    for size in (1, 2, 10):
        pieces = [batch.slice(i, size) for i in range(0, batch.num_rows, size)]
        flat = [(r["group"], r["term"], r["n"]) for b in R.run_counter(["group"], 1, 4)(iter(pieces)) for r in b.to_pylist()]
        listed = [r for b in R.run_counter(["group"], 1, 4, True)(iter(pieces)) for r in b.to_pylist()]
        assert Counter({(g, t): n for g, t, n in flat}) == expected and len(flat) == len(expected)
        assert sorted(flat) == sorted((r["group"], t, n) for r in listed for t, n in zip(r["term"], r["n"], strict=True))
        assert all(len(t.split()) == r["width"] for r in listed for t in r["term"])
