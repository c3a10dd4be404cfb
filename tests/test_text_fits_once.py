from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import market_checks, run_checks
from tidemark.functions import text as X
from tidemark.operators import fold_terms
from tidemark.session import keep_table


def test_panel_and_terms_of_the_text_fits_clean_the_posts_once(spark, tmp_path, monkeypatch):
    docs = [(i, "the cat and the dog sat http://x.org/a on the mat" if i % 2 else "un perro y un gato que van www.b.es", "en", 40 + i) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    orders = [(i, f"199{5 + i % 2}-0{1 + i % 9}-1{i % 9}", f"{1 + i % 5}-X", 100.0 + i) for i in range(90)]
    table = spark.createDataFrame(orders, "o_orderkey long, o_orderdate string, o_orderpriority string, o_totalprice double")
    table.withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    calls = []
    for module in (run_checks, market_checks):
        kept = module.clean_posts
        monkeypatch.setattr(module, "clean_posts", lambda *a, kept=kept: calls.append(1) or kept(*a))
    given = {}

    class Seen(Exception):
        pass

    def evaluate(panel, settings, terms, **_):
        given.update(panel=panel, terms=terms)
        raise Seen

    monkeypatch.setattr(run_checks, "evaluate_many", evaluate)
    with pytest.raises(Seen):
        run_checks.text_fits(spark, str(tmp_path))
    assert len(calls) == 1
    assert sorted(map(str, given["panel"].collect())) == sorted(map(str, run_checks._panel(spark, str(tmp_path)).collect()))
    assert sorted(given["terms"].collect()) == sorted(run_checks._cells_and_terms(spark, str(tmp_path))[1].collect())


def test_terms_below_the_least_of_every_span_get_no_list_of_spans(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(fold_terms, "keep_table", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep_table(df))
    terms = spark.createDataFrame([(a, w, t, n) for a in "AB" for w in (0, 2, 3) for t, n in (("x", 5), ("y", 3 + w), ("z", 1))], "asset string, week_start int, term string, n long")
    cells = spark.createDataFrame([("all", a, w, w) for a in "AB" for w in (0, 2, 3)], "group string, asset string, week_start int, span int")
    spans = spark.createDataFrame([("all", 5)], "group string, spans int")
    n_train = spark.createDataFrame([("all", i, 2) for i in range(5)], "group string, span int, n_train long")
    found = fold_terms.span_vocabularies(terms, cells, spans, n_train, max_features=2)
    # Sums up to a span: x 10, 10, 20, 30, 30; y 6, 6, 16, 28, 28; z 2, 2, 4, 6, 6.
    got = sorted((r["span"], r["term"], r["df"], r["cf"]) for r in found.collect())
    held = [(2, 10, 6), (2, 10, 6), (4, 20, 16), (6, 30, 28), (6, 30, 28)]
    assert got == sorted(row for s, (df, x, y) in enumerate(held) for row in ((s, "x", df, x), (s, "y", df, y)))
    assert any("Generate explode(filter(" in p.split("Filter")[0] and "_lowest" in p for p in plans)


def test_links_are_taken_out_whatever_else_a_text_holds(spark):
    texts = ["a HTTP://X.org/y?z b", "see WWW.a.b, c", "ftp://host/x kept", "a://b", "https://", "httpx www", "x https://a\u2003b www.", "wwww.q r", None]
    lowered = F.lower(F.coalesce("t", F.lit("")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(lowered, X.URL_PATTERN, " "), X.GAP_PATTERN, " "))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.clean_text(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"] == "a b"
    with_filter = spark.range(1).select(X.clean_text(F.lit("no link")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" in with_filter
