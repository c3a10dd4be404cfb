from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.settings import AssetQuery, PostSettings
from tidemark.sources import bars as B
from tidemark.sources import posts as P
from tidemark.sources.files import read_table, save_table

QUERIES = [
    AssetQuery("COIN", ("coins", "markets"), ("coin", "moon")),
    AssetQuery("INDEX", ("markets",), ("Market",)),
]
RAW_DDL = "id string, channel string, created_utc long, title string, body string, author string, score long, num_comments long"


def at(day, hour=0):
    return int((datetime(2024, 1, day, hour) - datetime(1970, 1, 1)).total_seconds())


def raw(spark):
    return spark.createDataFrame(
        [
            ("p1", "coins", at(3), "Coin to the MOON", None, "ann", 5, 2),
            ("p2", "markets", at(4), "Market likes the coin", " more words ", None, None, None),
            ("p3", "coins", at(5), None, "coin only in the body", "bob", 1, 1),
            ("p4", "elsewhere", at(6), "coin", "", "bob", 1, 1),
            ("p5", "coins", at(7), "another COIN", "", "", 1, 1),
            ("p6", "markets", at(20), "late market", "", "cyd", 1, 1),
        ],
        RAW_DDL,
    )


def comments(spark):
    return spark.createDataFrame(
        [
            ("c1", "p1", 0, at(3, 1), "first", "dan", 3), ("c2", "p1", 1, at(3, 2), "  ", "dan", 3),
            ("c3", "p1", 2, at(3, 3), "third", None, None), ("c4", "p9", 0, at(3, 1), "orphan", "dan", 3),
            ("c5", "p1", 3, at(3, 4), "beyond the cap", "dan", 3),
        ],
        "id string, post_id string, position long, created_utc long, body string, author string, score long",
    )


def test_tables_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "i int, s string, d double")
    for suffix in ("parquet", "csv"):
        path = str(tmp_path / f"t.{suffix}")
        save_table(df, path)
        save_table(df, path)
        assert sorted(map(tuple, read_table(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
        assert read_table(spark, path).columns == ["i", "s", "d"]
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "absent.parquet"))
    with pytest.raises(ValueError):
        save_table(df, str(tmp_path / "t.json"))
    save_table(df, str(tmp_path / "x.parquet"))
    (tmp_path / "y.json").write_text("{}")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "y.json"))


def test_posts_are_normalised(spark):
    rows = {r["source_id"]: r for r in P.normalize_posts(raw(spark)).collect()}
    assert rows["p1"]["text"] == "Coin to the MOON" and rows["p1"]["source_type"] == "submission"
    assert rows["p2"]["text"] == "Market likes the coin  more words"
    assert (rows["p2"]["author"], rows["p2"]["score"], rows["p2"]["num_comments"]) == ("[deleted]", 0, 0)
    assert rows["p5"]["author"] == "[deleted]"
    assert rows["p3"]["created_utc"] == datetime(2024, 1, 5)
    talk = {r["source_id"]: r for r in P.normalize_comments(comments(spark)).collect()}
    assert set(talk) == {"c1", "c3", "c4", "c5"} and talk["c3"]["author"] == "[deleted]"
    assert talk["c3"]["num_comments"] == 0 and talk["c3"]["score"] == 0


def test_matching_capping_and_first_match(spark):
    matched = P.match_posts(P.normalize_posts(raw(spark)), QUERIES)
    pairs = sorted((r["source_id"], r["asset"], r["keyword"]) for r in matched.collect())
    assert pairs == [
        ("p1", "COIN", "coin"), ("p1", "COIN", "moon"), ("p2", "COIN", "coin"), ("p2", "INDEX", "Market"),
        ("p5", "COIN", "coin"), ("p6", "INDEX", "Market"),
    ]
    earliest = P.cap_per_query(matched, 1)
    assert sorted(r["source_id"] for r in earliest.collect()) == ["p1", "p1", "p2", "p2"]
    newest = P.cap_per_query(matched, 1, newest=True)
    assert sorted(r["source_id"] for r in newest.collect()) == ["p1", "p2", "p5", "p6"]
    once = P.first_matches(matched)
    assert once.columns == schemas.POSTS.names
    assert sorted((r["source_id"], r["asset"], r["keyword"]) for r in once.collect()) == [
        ("p1", "COIN", "coin"), ("p2", "COIN", "coin"), ("p2", "INDEX", "Market"), ("p5", "COIN", "coin"),
        ("p6", "INDEX", "Market"),
    ]


def test_archive_and_search_order_of_steps(spark):
    one = PostSettings(max_posts_per_query=1)
    archive = P.collect_archive(raw(spark), QUERIES, "2024-01-04", "2024-01-10", one)
    assert sorted((r["source_id"], r["asset"]) for r in archive.collect()) == [("p1", "COIN"), ("p2", "COIN"), ("p2", "INDEX")]
    search = P.collect_search(raw(spark), QUERIES, "2024-01-01", "2024-01-10", settings=one)
    assert sorted((r["source_id"], r["asset"]) for r in search.collect()) == [("p1", "COIN"), ("p2", "COIN"), ("p5", "COIN")]


def test_comments_follow_their_post(spark):
    settings = PostSettings(include_comments=True, max_comments_per_post=3)
    out = P.collect_search(raw(spark), QUERIES, "2024-01-01", "2024-01-31", comments(spark), settings)
    rows = sorted((r["source_type"], r["source_id"], r["asset"], r["keyword"]) for r in out.collect())
    assert [r for r in rows if r[0] == "comment"] == [("comment", "c1", "COIN", "coin"), ("comment", "c3", "COIN", "coin")]
    assert out.columns == schemas.POSTS.names


def test_empty_posts_keep_their_schema(spark):
    out = P.collect_archive(schemas.empty(spark, schemas.RAW_POSTS), QUERIES, "2024-01-01", "2024-02-01")
    assert out.count() == 0 and out.columns == schemas.POSTS.names
    assert dict(out.dtypes)["score"] == "bigint"


def test_bars_from_exchange_records_and_close_series(spark):
    record = ["1704067200000", "1.5", "2", "1", "1.75", "10"] + ["0"] * 6
    bad_close = record[:4] + ["n/a"] + record[5:]
    bad_volume = record[:5] + [""] + record[6:]
    frame = spark.createDataFrame([(record,), (bad_close,), (bad_volume,), (["x"] + record[1:],)], "bar array<string>")
    rows = B.normalize_klines(frame).collect()
    assert len(rows) == 2 and {r["date"] for r in rows} == {datetime(2024, 1, 1)}
    assert sorted([r["volume"] is None for r in rows]) == [False, True]
    series = spark.createDataFrame([("2024-01-01", "5"), ("2024-01-02", "."), ("2024-01-03", "7")], "date string, close string")
    flat = B.normalize_close_series(series, "2024-01-01", "2024-01-03").collect()
    assert [tuple(r) for r in flat] == [(datetime(2024, 1, 1), 5.0, 5.0, 5.0, 5.0, 0.0)]
    both = B.union_market(spark, [("A", "A-USD", B.normalize_klines(frame)), ("B", "PROXY", B.normalize_close_series(series, "2024-01-01", "2025-01-01")), ("C", "C", None)])
    assert both.columns == schemas.BARS.names
    assert {(r["asset"], r["ticker"]): r["count"] for r in both.groupBy("asset", "ticker").count().collect()} == {("A", "A-USD"): 2, ("B", "PROXY"): 2}
    none = B.union_market(spark, [("C", "C", None)])
    assert none.count() == 0 and none.schema == schemas.BARS


def test_streamed_files_land_by_week(spark, tmp_path):
    from tidemark.streaming.landing import land_posts, matched_stream

    inbox, table, state = (str(tmp_path / n) for n in ("inbox", "table", "state"))
    raw(spark).write.json(inbox)
    land_posts(matched_stream(spark, inbox, QUERIES, 1), table, state).awaitTermination()
    raw(spark).withColumn("id", F.concat("id", F.lit("b"))).write.mode("append").json(inbox)
    land_posts(matched_stream(spark, inbox, QUERIES, 1), table, state).awaitTermination()
    landed = spark.read.parquet(table)
    assert landed.count() == 12
    assert landed.where(F.col("source_id").endswith("b")).count() == 6
    assert landed.select("week").distinct().count() == 2


@pytest.mark.parametrize("at_once", [50_000, 7])
def test_many_queries_by_pieces_of_their_keywords(spark, monkeypatch, at_once):
    monkeypatch.setattr(P, "INDEX_QUERIES", at_once)
    words = ["moon", "Moon", "MOONS", "oo", "o", "", "été", "ÉTÉ", "no", "noon", "on the", "aaaa", "zzz", "東京", "京", "coin coin"]
    queries = [AssetQuery(f"A{i % 3}", ("x", "y")[: 1 + i % 2], tuple(words[i:] + words[:i])) for i in range(3)]
    titles = ["To the MOON and moons", "noon on the moon", "aaa", "aaaaa", "Été à 東京", "", "coin  coin coin", None, "o", "zz z"]
    rows = [(f"p{i}", c, t, i) for i, t in enumerate(titles) for c in ("x", "y", "z")]
    posts = spark.createDataFrame(rows, "source_id string, channel string, title string, at int")
    expected = sorted(
        (s, c, a, q.asset, k, (i, ci, ki)) for s, c, t, a in rows for i, q in enumerate(queries) for ci, ch in enumerate(q.channels)
        for ki, k in enumerate(q.keywords) if ch == c and t is not None and k.lower() in t.lower()
    )
    found = P.match_by_grams(posts, queries)
    assert sorted((r["source_id"], r["channel"], r["at"], r["asset"], r["keyword"], tuple(r["query_no"])) for r in found.collect()) == expected
    joined = P.match_posts(posts, queries)
    assert sorted((r["source_id"], r["channel"], r["at"], r["asset"], r["keyword"], tuple(r["query_no"])) for r in joined.collect()) == expected
    monkeypatch.setattr(P, "INDEX_FROM", 1)
    assert P.match_posts(posts, queries).count() == len(expected)


def test_each_keyword_stands_under_its_rarest_piece():
    index = P.gram_index(["abcd", "abce", "abc", "x", ""])
    assert index == {"bcd": ["abcd"], "bce": ["abce"], "abc": ["abc"], "x": ["x"], "": [""]}


def test_large_caps_keep_the_same_posts(spark, monkeypatch):
    rows = [("A", "c", "k" if i % 5 else "l", f"p{i % 900}", datetime(2024, 1, 1 + i % 20), i) for i in range(1_500)]
    matched = spark.createDataFrame(rows, "asset string, channel string, keyword string, source_id string, created_utc timestamp, score long")
    plain = {(n, new): sorted(tuple(r) for r in P.cap_per_query(matched, n, new).collect()) for n in (7, 400) for new in (False, True)}
    monkeypatch.setattr(P, "MAP_SIDE_ROWS", 1)
    monkeypatch.setattr("tidemark.operators.top_rows.MAP_SIDE_ROWS", 1)
    monkeypatch.setattr("tidemark.operators.slices.slice_bounds.__defaults__", (100,))
    for (n, new), expected in plain.items():
        got = P.cap_per_query(matched, n, new)
        assert got.columns == matched.columns and sorted(tuple(r) for r in got.collect()) == expected


def test_sorted_tables_are_ranges_of_their_order(spark, tmp_path):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("id"), (F.col("id") % 3).cast("string").alias("asset")).repartition(6)
    save_table(df, str(tmp_path / "t.parquet"), ["asset", "id"])
    files = {}
    for r in read_table(spark, str(tmp_path / "t.parquet")).select("asset", "id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect():
        files.setdefault(r["file_name"], []).append((r["asset"], r["id"]))
    assert sum(map(len, files.values())) == 5_000 and all(rows == sorted(rows) for rows in files.values())
    ranges = sorted((rows[0], rows[-1]) for rows in files.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_sketches_of_weeks_merge_to_those_of_spans(spark):
    from tidemark.operators.weekly_text import author_sketches, authors_in_spans

    rows = [("A" if i % 2 else "B", datetime(2024, 1, 1 + 7 * (i % 4)), f"u{i * i % 9_001}" if i % 7 else None) for i in range(30_000)]
    posts = spark.createDataFrame(rows, "asset string, week_start timestamp, author string")
    whole = authors_in_spans(author_sketches(posts), F.trunc("week_start", "month")).collect()
    direct = {r["asset"]: r["n"] for r in posts.groupBy("asset").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce("author", F.lit("[unknown]")), 12)).alias("n")).collect()}
    exact = {a: len({r[2] for r in rows if r[0] == a}) for a in "AB"}
    for r in whole:
        assert r["authors"] == direct[r["asset"]] and abs(r["authors"] / exact[r["asset"]] - 1) < 4 * 1.04 / 64


def test_streamed_volume_equals_the_batch(spark, tmp_path):
    """Files in the order of time, with repeated and with late posts; only those beyond the delay are left out.

    Spark judges lateness by the watermark that the batch before the last one gave.
    """
    from tidemark.schemas import POSTS
    from tidemark.streaming.landing import land_volume, landed_volume, weekly_volume

    def post(i, day, asset="A"):
        return (asset, "ch", "submission", f"p{i}", datetime(2024, 1, day), "u", 1, 1, "text", "k")

    files = [[post(1, 2), post(2, 3), post(1, 2, "B")], [post(2, 3), post(3, 9), post(4, 2)], [post(3, 9), post(5, 30)], [post(8, 31)], [post(6, 29), post(7, 2)]]
    folder = tmp_path / "posts"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, POSTS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    land_volume(weekly_volume(stream, "10 days"), str(tmp_path / "volume"), str(tmp_path / "state")).awaitTermination()
    kept = {(p[0], p[3]): p[4] for rows in files for p in rows if p[3] != "p7"}
    expected = {}
    for (asset, _), at in kept.items():
        week = (at.date() - timedelta(days=at.weekday()), asset)
        expected[week] = expected.get(week, 0) + 1
    assert {(r["week_start"].date(), r["asset"]): r["posts"] for r in landed_volume(spark, str(tmp_path / "volume")).collect()} == expected


def test_pieces_of_a_title_are_taken_in_one_native_pass(spark):
    from pyspark.sql import functions as F

    from tidemark.sources import posts as P

    titles = ["abcabd", "a\nb😀cd", "ab", "", "ééx abc", None]
    grams = sorted(["abc", "b😀c", "😀cd", "ab", "éx ", "zzz"], key=lambda g: g.encode())
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    plan = df.select(P._title_grams(F.col("t"), [2, 3]))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "lambda" not in plan
    for row in df.select("t", P._held(F.col("t"), grams).alias("found")).collect():
        if row["t"] is None:
            assert row["found"] is None
            continue
        own = {row["t"][i : i + n] for n in (2, 3) for i in range(len(row["t"]) - n + 1)}
        assert sorted(row["found"]) == sorted(own & set(grams))
