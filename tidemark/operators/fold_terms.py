"""Vocabularies of all training spans of a study from one pass over the term counts.

Spans of a group are nested: each ends later than the one before. So a cell counts from the first span that holds
it on, and document frequency and frequency of a term in a span are prefix sums over blocks of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.terms import CELL
from tidemark.operators.top_rows import first_rows
from tidemark.session import keep_table


def _grown_terms(terms: DataFrame, cells: DataFrame, spans: DataFrame, min_df: int) -> DataFrame:
    """(group, term, span, end, df, cf): what holds for a term from a span to the last one before its next change.

    Terms that come shuffled by the term, with few cells, are counted where they are.
    """
    counted = terms.join(cells, list(CELL)).groupBy("group", "term", "span").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
    along = Window.partitionBy("group", "term").orderBy("span")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    grown = counted.select(
        "group", "term", "span", F.lead("span").over(along).alias("_next"), F.sum("df").over(upto).alias("df"), F.sum("cf").over(upto).alias("cf")
    ).where(F.col("df") >= min_df)
    end = F.coalesce("_next", "spans") - 1
    return grown.join(F.broadcast(spans), "group").select("group", "term", "span", end.alias("end"), "df", "cf")


def span_terms(terms: DataFrame, cells: DataFrame, spans: DataFrame, min_df: int = 2) -> DataFrame:
    """(group, span, term, df, cf) of every term that ``min_df`` training cells of the span hold.

    ``terms``: (asset, week_start, term, n). ``cells``: (group, asset, week_start, span), the first span, from 0, that
    trains on the cell. ``spans``: (group, spans), how many there are. The terms are read once, counted per
    (group, term, first span) before the shuffle, and summed up along the spans, of which a term has a row from
    its own change on.
    """
    grown = _grown_terms(terms, cells, spans, min_df)
    return grown.select("group", F.explode(F.sequence(F.col("span"), F.col("end"))).alias("span"), "term", "df", "cf")


def span_vocabularies(
    terms: DataFrame, cells: DataFrame, spans: DataFrame, n_train: DataFrame, max_features: int = 8000, min_df: int = 2
) -> DataFrame:
    """(group, span, term, df, cf, idf): the ``max_features`` most frequent terms of each span, ties by the term.

    ``n_train``: (group, span, n_train), the training rows of each span; rows without text count as documents.
    Terms by frequency are counted first, which gives the least frequency that a span's vocabulary needs. Only terms
    with at least that one get a row for each span, and only those that have just that one are ordered by the term.
    """
    grown = keep_table(_grown_terms(terms, cells, spans, min_df))
    steps = F.explode(F.sequence(F.col("span"), F.col("end"))).alias("span")
    sizes = grown.groupBy("group", "span", "end", "cf").agg(F.count("*").alias("n")).select("group", steps, "cf", "n")
    sizes = sizes.groupBy("group", "span", "cf").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("group", "span").orderBy(F.col("cf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("_above") < max_features)
    least = keep_table(sizes.groupBy("group", "span").agg(F.min("cf").alias("least")))
    by_group = least.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("span", "least"))).alias("_map"), F.max("span").alias("_top"), F.min("least").alias("_lowest"))
    # By place, as a map is searched from its start for every span of every term; most terms reach no span's least.
    by_group = by_group.select("group", "_lowest", F.transform(F.sequence(F.lit(0), "_top"), lambda i: F.col("_map")[i]).alias("_least"))
    wanted = F.filter(F.sequence(F.col("span"), F.col("end")), lambda i: F.col("cf") >= F.get("_least", i))
    reach = grown.join(F.broadcast(by_group), "group").where(F.col("cf") >= F.col("_lowest"))
    found = reach.select("group", F.explode(wanted).alias("span"), "term", "df", "cf")
    found = keep_table(found.withColumn("_less", -F.col("cf")))
    kept = first_rows(found, ["group", "span"], ["_less", "term"], max_features).drop("_less")
    idf = F.log((F.col("n_train") + 1.0) / (F.col("df") + 1.0)) + 1.0
    return kept.join(n_train, ["group", "span"]).select("group", "span", "term", "df", "cf", idf.alias("idf"))
