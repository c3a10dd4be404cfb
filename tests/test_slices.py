from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators.slices import previous_value, slice_bounds, slice_of, sum_before
from tidemark.operators.top_rows import best_per_group, first_per_key, latest_rows, top_per_group


def sample(spark, rows=2000, seed=5):
    """One key and one instant hold a third of the rows each."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(7)}"
        at = 500 if rng.random() < 0.34 else rng.randrange(1000)
        data.append((key, at, f"id{i:05d}", rng.randrange(50), None if i % 11 == 0 else float(i)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, at long, id string, n long, v double").repartition(5)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_no_slices_for_a_small_input(spark):
    assert slice_bounds(sample(spark, 200), ["key", "at", "id"]) == []


def test_slices_cut_hot_keys_and_hot_instants(spark):
    df = sample(spark)
    order = ["key", "at", "id"]
    bounds = slice_bounds(df, order, rows_per_slice=100)
    assert 10 <= len(bounds) <= 20
    sizes = df.groupBy(slice_of(order, bounds).alias("s")).count().agg(F.max("count")).first()[0]
    assert sizes < 500
    again = sorted((tuple(r[c] for c in order), r["s"]) for r in df.select("*", slice_of(order, bounds).alias("s")).collect())
    numbers = [s for _, s in again]
    assert numbers == sorted(numbers)


def test_previous_value_does_not_depend_on_the_slices(spark):
    df = sample(spark)
    plain = previous_value(df, ["key"], ["at", "id"], ["v", "n"], bounds=[])
    bounds = slice_bounds(df, ["key", "at", "id"], rows_per_slice=90)
    sliced = previous_value(df, ["key"], ["at", "id"], ["v", "n"], bounds=bounds)
    assert sliced.columns == plain.columns
    assert as_set(sliced) == as_set(plain)
    odd = previous_value(df, ["key"], ["at", "id"], ["v", "n"], bounds=[("hot", 500, "id00003"), ("zz", 0, "")])
    assert as_set(odd) == as_set(plain)


def test_sum_before_does_not_depend_on_the_slices(spark):
    df = sample(spark)
    plain = sum_before(df, ["key"], ["at", "id"], ["n"], bounds=[])
    bounds = slice_bounds(df, ["key", "at", "id"], rows_per_slice=90)
    assert as_set(sum_before(df, ["key"], ["at", "id"], ["n"], bounds=bounds)) == as_set(plain)
    rows = sorted((r["key"], r["at"], r["id"], r["n"], r["before_n"]) for r in plain.collect())
    running, key = 0, None
    for row in rows:
        running = running if row[0] == key else 0
        key = row[0]
        assert row[4] == running
        running += row[3]


def test_slice_search_survives_many_bounds(spark):
    df = spark.range(5000).select(F.col("id").alias("at"), (F.col("id") % 3).alias("key"), F.lit(1).alias("n"))
    bounds = [(k, a) for k in range(3) for a in range(0, 5000, 15)]
    out = sum_before(df, ["key"], ["at"], ["n"], bounds=bounds)
    assert out.where(F.col("before_n") != F.floor(F.col("at") / 3)).count() == 0


def test_first_per_key_is_the_smallest_in_order(spark):
    df = sample(spark)
    got = {r["key"]: r["id"] for r in first_per_key(df, ["key"], [F.col("at")]).collect()}
    best = {}
    for r in df.collect():
        rank = (r["at"], r["at"], r["id"])
        best[r["key"]] = min(best.get(r["key"], (rank, r["id"])), (rank, r["id"]))
    assert got == {k: v[1] for k, v in best.items()}


def test_top_per_group_matches_a_sort(spark):
    df = sample(spark)
    for lanes in (1, 3, 64):
        got = top_per_group(df, ["key"], [F.col("at").desc(), F.col("id")], 9, lanes)
        expected = []
        for key in {r["key"] for r in df.select("key").distinct().collect()}:
            rows = [r for r in df.collect() if r["key"] == key]
            expected += sorted(rows, key=lambda r: (-r["at"], r["id"]))[:9]
        assert as_set(got) == sorted((tuple(r) for r in expected), key=str)
        assert got.columns == df.columns


def test_latest_rows_and_best_row(spark):
    df = spark.createDataFrame(
        [("m", "a", 1, 0.5), ("m", "a", 3, 0.6), ("m", "a", 2, 0.7), ("m", "b", 1, 0.1)],
        "model string, asset string, week_start int, score double",
    )
    got = sorted((r["asset"], r["week_start"]) for r in latest_rows(df, ["model", "asset"], 2).collect())
    assert got == [("a", 2), ("a", 3), ("b", 1)]
    metrics = spark.createDataFrame(
        [("x", "b", 0.7), ("x", "a", 0.7), ("x", "c", None), ("y", "z", None)], "g string, model string, m double"
    )
    best = {r["g"]: r["model"] for r in best_per_group(metrics, ["g"], "m", "model").collect()}
    assert best == {"x": "a", "y": "z"}
