"""Term counts per (asset, week) and their TF-IDF weights, without building the weekly strings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import outer_tokens, word_tokens
from tidemark.operators.run_counts import run_counter
from tidemark.operators.slices import Bounds, previous_value, slice_bounds

CELL = ("asset", "week_start")


LONGEST = 10
#: Characters of text whose terms one task counts, about, and tasks at most (beyond, tasks get more text).
TASK_CHARS, MOST_TASKS = 8_000_000, 20_000
SMALL_CHARS, SMALL_TASKS = 500_000, 16
#: A cell with more characters is counted in several parts.
CELL_CHARS = 32_000_000


def _check_range(ngram_range: tuple[int, int]) -> tuple[bool, bool]:
    low, high = ngram_range
    if not 1 <= low <= high <= LONGEST:
        raise ValueError(f"n-gram range has to lie within (1, {LONGEST}), not {ngram_range}")
    return low == 1, high == 2


def _ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by spaces."""

    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def _long_spanning(cleaned: DataFrame, high: int, bounds: Bounds | None) -> DataFrame:
    """(cell, order, cut, tokens): runs of more than two tokens may span several short posts; the borders that they cross.

    The last ``high - 1`` tokens before a post are a border: those of a run of posts follow from the border of the
    run without its last post and that post's own tokens, so ``high - 2`` steps to the post before reach far
    enough, as each post with a token gives at least one. A row holds the border, of ``cut`` tokens, and the post's first ones.
    """
    reach = high - 1
    rows = cleaned.select(*CELL, *_order(), word_tokens(F.col("clean_text")).alias("_tokens")).where(F.size("_tokens") > 0)
    order = list(ORDER)
    own = F.slice("_tokens", F.greatest(F.size("_tokens") - (reach - 1), F.lit(1)), reach)
    ends = rows.select(*CELL, *order, F.slice("_tokens", 1, reach).alias("_head"), own.alias("_own"))
    ends = ends.withColumn("_tail", F.col("_own"))
    if bounds is None:
        bounds = slice_bounds(ends, [*CELL, *order])
    for _ in range(reach - 1):
        both = F.concat(F.coalesce("prev__tail", F.array().cast("array<string>")), "_own")
        ends = previous_value(ends, CELL, order, ["_tail"], bounds=bounds).select(
            *CELL, *order, "_head", "_own", F.slice(both, F.greatest(F.size(both) - (reach - 1), F.lit(1)), reach).alias("_tail")
        )
    follow = previous_value(ends, CELL, order, ["_tail"], bounds=bounds).where(F.col("prev__tail").isNotNull())
    return follow.select(*CELL, *order, F.size("prev__tail").alias("cut"), F.concat("prev__tail", "_head").alias("tokens"))


def _pairs(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space; none for fewer than two tokens."""
    return F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def _counts(rows: DataFrame, tokens: str, singles: bool, pairs: bool) -> DataFrame:
    terms = []
    if singles:
        terms.append(F.col(tokens))
    if pairs:
        terms.append(_pairs(F.col(tokens)))
    return rows.select(*CELL, F.explode(F.concat(*terms)).alias("term"))


ORDER = ("_at", "source_id", "_tie")


def _order() -> list[Column]:
    """What orders the posts of a cell."""
    return [F.unix_micros("created_utc").alias("_at"), F.col("source_id"), F.xxhash64("clean_text").alias("_tie")]


def _spanning_pairs(cleaned: DataFrame, bounds: Bounds | None) -> DataFrame:
    """(cell, order, cut, tokens): the word pair that ends in a post and begins in the one before."""
    first, last = outer_tokens(F.col("clean_text"))
    ends = cleaned.select(*CELL, *_order(), first.alias("_first"), last.alias("_last")).where(F.col("_first") != "")
    follow = previous_value(ends, CELL, list(ORDER), ["_last"], bounds=bounds).where(F.col("prev__last").isNotNull())
    return follow.select(*CELL, *ORDER, F.lit(1).alias("cut"), F.array("prev__last", "_first").alias("tokens"))


def term_tasks(chars: int | None) -> int:
    """Tasks among which the terms of so much text are dealt; a small text is spread as well."""
    chars = chars or 0
    return max(1, min(SMALL_TASKS, chars // SMALL_CHARS), min(MOST_TASKS, math.ceil(chars / TASK_CHARS)))


def text_size(cleaned: DataFrame) -> int:
    """Characters of all posts; give a table that is cheap to read twice."""
    return cleaned.agg(F.sum(F.length("clean_text"))).first()[0] or 0


def post_terms(
    cleaned: DataFrame, ngram_range: tuple[int, int] = (1, 2), bounds: Bounds | None = None, cell_chars: int = CELL_CHARS,
    listed: bool = False,
) -> DataFrame:
    """(asset, week_start, term, n) from cleaned posts; ``listed``: (asset, week_start, width, term, n), in lists of bounded size.

    Equal to counting in the weekly text: runs that span posts are counted too. The posts are shuffled by their cell,
    each once, ordered and counted where they arrive, as numbers (``operators.run_counts``), so that no term is shuffled: a
    cell has far more rows of terms than bytes of text. The posts of a cell of more than ``cell_chars`` characters are
    dealt among several tasks without their order; the runs that span them come from the first and last tokens of each post,
    which are ordered in slices, and only the counts are added up by a second shuffle.
    The sizes of the cells are read here: give a table that is cheap to read twice.
    """
    low, high = ngram_range
    _check_range(ngram_range)
    sizes = cleaned.groupBy(*CELL).agg(F.sum(F.length("clean_text")).alias("_chars"))
    chars, most = sizes.agg(F.sum("_chars"), F.max("_chars")).first()
    tasks = max(2, term_tasks(chars))
    if (most or 0) <= cell_chars:
        placed = cleaned.select(*CELL, *_order(), "clean_text").repartition(tasks, *CELL).sortWithinPartitions(*CELL, *ORDER)
        return _run_counts(placed, CELL, F.lit(True), low, high, listed)
    large = sizes.where(F.col("_chars") > cell_chars).select(
        *[F.col(c).alias(f"_{c}") for c in CELL], F.ceil(F.col("_chars") / cell_chars).cast("int").alias("_parts")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL]
    rows = cleaned.select(*CELL, *_order(), "clean_text")
    small = rows.join(F.broadcast(large), same, "left_anti").repartition(tasks, *CELL).sortWithinPartitions(*CELL, *ORDER)
    dealt = rows.withColumns({"cut": F.lit(0), "tokens": F.lit(None).cast("array<string>")})
    if high > 1:
        hot = cleaned.join(F.broadcast(large), same, "left_semi")
        across = _long_spanning(hot, high, bounds) if high > 2 else _spanning_pairs(hot, bounds)
        dealt = dealt.unionByName(across.withColumn("clean_text", F.lit("")))
    part = F.pmod(F.xxhash64(*ORDER), F.col("_parts")).cast("int")
    dealt = dealt.join(F.broadcast(large), same).withColumn("_part", part).repartition(tasks, *CELL, "_part").sortWithinPartitions(*CELL, "_part")
    parts = _run_counts(dealt, (*CELL, "_part"), F.lit(False), low, high)
    merged = parts.groupBy(*CELL, "term").agg(F.sum("n").alias("n"))
    if listed:
        merged = merged.select(*CELL, F.size(F.split("term", " ")).alias("width"), F.array("term").alias("term"), F.array("n").alias("n"))
    return _run_counts(small, CELL, F.lit(True), low, high, listed).unionByName(merged)


def _run_counts(placed: DataFrame, group: Sequence[str], joined: Column, low: int, high: int, listed: bool = False) -> DataFrame:
    """(group, term, n) of posts, or of borders between them, that lie beside those of their group."""
    own = word_tokens(F.col("clean_text"))
    border = "tokens" in placed.columns
    tokens, cut = (F.coalesce("tokens", own), F.col("cut")) if border else (own, F.lit(0))
    rows = placed.select(*group, joined.alias("joined"), cut.alias("cut"), tokens.alias("tokens"))
    found = T.StructType([placed.schema[c] for c in group])
    if listed:
        found.add("width", T.IntegerType()).add("term", T.ArrayType(T.StringType())).add("n", T.ArrayType(T.LongType()))
    else:
        found.add("term", T.StringType()).add("n", T.LongType())
    return rows.mapInArrow(run_counter(group, low, high, listed), found)


def text_terms(panel: DataFrame, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """The same counts from a ``weekly_text`` column."""
    singles, pairs = _check_range(ngram_range)
    tokenised = panel.select(*CELL, word_tokens(F.col("weekly_text")).alias("_tokens"))
    if ngram_range[1] > 2:
        long = tokenised.where(F.size("_tokens") > 0).select(*CELL, F.explode(_ngrams(F.col("_tokens"), *ngram_range)).alias("term"))
        return long.groupBy(*CELL, "term").agg(F.count("*").alias("n"))
    return _counts(tokenised, "_tokens", singles, pairs).groupBy(*CELL, "term").agg(
        F.count("*").alias("n")
    )


def shared_terms(terms: DataFrame, min_df: int = 2, tasks: int | None = None) -> DataFrame:
    """The counts of terms that at least ``min_df`` cells hold.

    No part of the cells holds a term more often than all do, so a vocabulary of any part, such as
    a training block, loses nothing. The rows are shuffled once, by the term (into ``tasks``, else as many as the
    session says). A term has one row per cell; the rows of a term are counted once for all of them,
    sorted by hash, as numbers compare faster. Terms stay together, so that counting by term needs no further shuffle.
    """
    placed = (terms.repartition(tasks, "term") if tasks else terms.repartition("term")).withColumn("_hash", F.xxhash64("term"))
    same = Window.partitionBy("_hash", "term")
    return placed.withColumn("_cells", F.count("*").over(same)).where(F.col("_cells") >= min_df).select(*terms.columns)


def vocabulary(
    terms: DataFrame, n_docs: int | Column, max_features: int = 8000, min_df: int = 2
) -> DataFrame:
    """(idx, term, df, idf): the most frequent terms that ``min_df`` cells hold.

    At most ``max_features`` rows leave the top-n, which bounds the numbering window and the
    broadcast of this table. Equal frequencies are settled by the term.
    """
    total = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    kept = (
        terms.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
        .where(F.col("df") >= min_df)
        .orderBy(F.col("cf").desc(), F.col("term"))
        .limit(max_features)
    )
    return kept.select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "term", "df",
        (F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"),
    )


def tfidf_weights(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(asset, week_start, idx, term, weight) with unit length per (asset, week).

    ``vocab`` holds at most ``max_features`` rows, so it is broadcast, and no cell's window
    holds more rows than that.
    """
    raw = terms.join(F.broadcast(vocab), "term").select(
        *CELL, "idx", "term", (F.col("n") * F.col("idf")).alias("_raw")
    )
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*CELL)))
    return raw.select(*CELL, "idx", "term", (F.col("_raw") / length).alias("weight"))


@dataclass(frozen=True)
class TextVectors:
    """A fitted vocabulary: terms in index order and their weights (at most ``max_features``)."""

    terms: tuple[str, ...]
    vocab: DataFrame

    @property
    def size(self) -> int:
        return len(self.terms)

    def transform(self, cells: DataFrame, terms: DataFrame, column: str = "text_vector") -> DataFrame:
        """Adds the sparse TF-IDF vector of each (asset, week); cells without terms get zeros."""
        size = self.size

        @F.udf(VectorUDT())
        def sparse(entries):
            return SparseVector(size, [(e["idx"], e["value"]) for e in entries or ()])

        raw = terms.join(F.broadcast(self.vocab), "term").groupBy(*CELL).agg(
            F.collect_list(F.struct("idx", (F.col("n") * F.col("idf")).alias("raw"))).alias("_entries")
        )
        norm = F.aggregate("_entries", F.lit(0.0), lambda acc, e: acc + e["raw"] * e["raw"])
        scaled = F.transform(
            F.sort_array("_entries"),
            lambda e: F.struct(e["idx"].alias("idx"), (e["raw"] / F.col("_norm")).alias("value")),
        )
        vectors = raw.withColumn("_norm", F.sqrt(norm)).select(*CELL, scaled.alias("_entries"))
        return (
            cells.join(vectors, list(CELL), "left")
            .withColumn(column, sparse("_entries"))
            .drop("_entries")
        )


def fit_text_vectors(
    terms: DataFrame, train_cells: DataFrame, n_train: int, max_features: int = 8000, min_df: int = 2
) -> TextVectors:
    """Vocabulary and idf from the training cells alone; cells without text count as documents."""
    seen = terms.join(train_cells.select(*CELL), list(CELL), "left_semi")
    rows = vocabulary(seen, n_train, max_features, min_df).orderBy("idx").collect()
    spark = terms.sparkSession
    vocab = spark.createDataFrame(
        [(r["idx"], r["term"], r["idf"]) for r in rows], "idx int, term string, idf double"
    )
    return TextVectors(tuple(r["term"] for r in rows), vocab)
