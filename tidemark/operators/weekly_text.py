"""Posts to weekly text features, weekly text and weekly terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_start
from tidemark.functions.numeric import finite, sign_flags
from tidemark.functions.text import clean_text, keyword_hits
from tidemark.operators.sentiment import PolarityRules, PredictorFactory, with_sentiment
from tidemark.operators.slices import Bounds, sum_before

CELL = ("asset", "week_start")
MAX_CHANNEL_COLUMNS = 2_000
PIECE_CHARS = 1_000_000
MAX_CELL_CHARS = 100_000_000


def clean_posts(posts: DataFrame, min_text_length: int = 15, anchor: str = "W-SUN") -> DataFrame:
    """Posts with ``clean_text``, its length and the week; short ones and keyless ones drop out.

    The cleaned text passes a one-element explode: a plain column would be computed twice,
    once in the length filter that Catalyst pushes below it and once in the output.
    """
    keyed = posts.withColumn("created_utc", F.col("created_utc").cast("timestamp")).where(
        F.col("asset").isNotNull() & F.col("created_utc").isNotNull()
    )
    others = [c for c in keyed.columns if c != "text"]
    cleaned = keyed.select(*others, F.explode(F.array(clean_text(F.col("text")))).alias("clean_text"))
    return (
        cleaned.withColumn("text_len", F.length("clean_text"))
        .where(F.col("text_len") >= min_text_length)
        .withColumn("week_start", week_start(F.col("created_utc"), anchor))
    )


def channel_names(posts: DataFrame) -> list[str]:
    """The channels of a table, sorted; refuses a number of columns no table should have."""
    found = posts.select("channel").where(F.col("channel").isNotNull()).distinct()
    names = [row[0] for row in found.limit(MAX_CHANNEL_COLUMNS + 1).collect()]
    if len(names) > MAX_CHANNEL_COLUMNS:
        raise ValueError(
            f"more than {MAX_CHANNEL_COLUMNS} channels: name the ones to pivot, or use channel_counts"
        )
    return sorted(names)


def channel_counts(cleaned: DataFrame) -> DataFrame:
    """Posts per (asset, week, channel) in long form, for any number of channels."""
    return cleaned.where(F.col("channel").isNotNull()).groupBy(*CELL, "channel").agg(
        F.count("*").cast("double").alias("posts")
    )


def channel_columns(channels: Sequence[str]) -> list[Column]:
    return [
        F.sum(F.when(F.col("channel") == name, 1.0).otherwise(0.0)).alias(f"post_channel_{name}_count")
        for name in channels
    ]


def _score_stats(column: str, prefix: str) -> list[Column]:
    up, down = sign_flags(F.col(column))
    return [
        F.avg(column).alias(f"{prefix}_mean"),
        F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias(f"{prefix}_std"),
        F.avg(up).alias(f"{prefix}_pos_share"),
        F.avg(down).alias(f"{prefix}_neg_share"),
    ]


def weekly_stats(
    scored: DataFrame, keyword_lexicon: Sequence[str], channels: Sequence[str] = ()
) -> DataFrame:
    """One row per (asset, week) from cleaned and scored posts, in one aggregation.

    Channel counts are conditional sums in the same pass, so nothing is joined back. All
    aggregates combine on the map side; a hot (asset, week) is spread by its authors.
    """
    work = scored.withColumn("_hits", keyword_hits(F.col("clean_text"), keyword_lexicon))
    stats: list[Column] = [
        F.count("source_id").alias("post_count"),
        F.count_distinct(F.coalesce("author", F.lit("[unknown]"))).alias("post_unique_authors"),
        F.sum("score").alias("post_score_sum"),
        F.avg("score").alias("post_score_mean"),
        F.sum("num_comments").alias("post_comments_sum"),
        F.avg("num_comments").alias("post_comments_mean"),
        F.avg("text_len").alias("post_text_len_mean"),
        F.sum("_hits").alias("post_keyword_hits_sum"),
        F.count_distinct("channel").alias("post_channel_nunique"),
    ]
    if "lex_compound" in scored.columns:
        stats += _score_stats("lex_compound", "post_lex_sentiment")
    if "model_sentiment" in scored.columns:
        stats += [
            F.avg(f"model_{label}").alias(f"post_model_{label}_mean")
            for label in ("positive", "negative", "neutral")
        ]
        stats += _score_stats("model_sentiment", "post_model_sentiment")
    stats += channel_columns(channels)
    weekly = work.groupBy(*CELL).agg(*stats)
    numbers = [c for c in weekly.columns if c not in CELL]
    return weekly.select(
        *CELL,
        *[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in numbers],
    )


def weekly_text_features(
    posts: DataFrame,
    keyword_lexicon: Sequence[str] = (),
    min_text_length: int = 15,
    anchor: str = "W-SUN",
    backend: str = "lexicon",
    lexicon: Mapping[str, float] | DataFrame | None = None,
    factory: PredictorFactory | None = None,
    batch_size: int = 16,
    channels: Sequence[str] | None = None,
    rules: PolarityRules = PolarityRules(),
) -> DataFrame:
    """Activity, engagement, keyword, sentiment and channel features per (asset, week)."""
    cleaned = clean_posts(posts, min_text_length, anchor)
    return cleaned_text_features(
        cleaned, keyword_lexicon, backend, lexicon, factory, batch_size, channels, rules
    )


def cleaned_text_features(
    cleaned: DataFrame,
    keyword_lexicon: Sequence[str] = (),
    backend: str = "lexicon",
    lexicon: Mapping[str, float] | DataFrame | None = None,
    factory: PredictorFactory | None = None,
    batch_size: int = 16,
    channels: Sequence[str] | None = None,
    rules: PolarityRules = PolarityRules(),
) -> DataFrame:
    """The same from cleaned posts, one row per post. Channels not given are looked up first."""
    if channels is None:
        channels = channel_names(cleaned)
    scored = with_sentiment(cleaned, backend, lexicon, factory, batch_size, rules)
    return weekly_stats(scored, keyword_lexicon, channels)


def weekly_text_pieces(
    cleaned: DataFrame, piece_chars: int = PIECE_CHARS, bounds: Bounds | None = None
) -> DataFrame:
    """The text of each (asset, week) in posting order, in numbered pieces.

    Nothing is left out: joining the pieces of a cell with spaces gives its whole text. A
    piece holds about ``piece_chars`` characters (the post that crosses the mark is kept
    whole), so a cell of any size is spread over many rows and tasks. Posts of one instant
    are ordered by id.
    """
    keyed = cleaned.select(
        *CELL, F.unix_micros("created_utc").alias("_at"), "source_id", "clean_text",
        F.xxhash64("clean_text").alias("_tie"), (F.col("text_len") + 1).cast("long").alias("chars"),
    )
    placed = sum_before(keyed, CELL, ["_at", "source_id", "_tie"], ["chars"], bounds=bounds)
    piece = F.floor(F.col("before_chars") / F.lit(piece_chars)).cast("long")
    posts = F.sort_array(F.collect_list(F.struct("_at", "source_id", "_tie", "clean_text")))
    return placed.groupBy(*CELL, piece.alias("piece")).agg(
        F.array_join(F.transform(posts, lambda p: p["clean_text"]), " ").alias("piece_text"),
        F.count("*").alias("posts"),
    )


def weekly_text(
    cleaned: DataFrame, max_chars: int = MAX_CELL_CHARS, bounds: Bounds | None = None
) -> DataFrame:
    """One ``weekly_text`` string per (asset, week), for cells that fit into a row.

    A cell longer than ``max_chars`` raises instead of being cut; such data is read as pieces
    (``weekly_text_pieces``) or as terms (``operators.terms``), which have no such limit. The
    size is checked on the pieces, before any cell is put together.
    """
    pieces = weekly_text_pieces(cleaned, max(1, max_chars // 16), bounds)
    refuse = F.raise_error(F.lit(f"weekly text longer than {max_chars} characters: use pieces or terms"))
    checked = pieces.withColumn(
        "piece_text", F.when(F.col("piece") > 16, refuse).otherwise(F.col("piece_text"))
    )
    parts = F.sort_array(F.collect_list(F.struct("piece", "piece_text")))
    return checked.groupBy(*CELL).agg(
        F.array_join(F.transform(parts, lambda p: p["piece_text"]), " ").alias("weekly_text")
    )


def author_sketches(cleaned: DataFrame, precision: int = 12) -> DataFrame:
    """(asset, week_start, authors): a HyperLogLog sketch of the different authors, missing ones counted as one.

    For spans of weeks whose exact counts would need the posts again: sketches are small, stored once, and merged by
    :func:`authors_in_spans`. The relative standard error is about 1.04 / sqrt(2^precision), 1.6 % at 12, and close to
    none for few authors. The exact weekly count stays the default of the weekly features.
    """
    author = F.coalesce(F.col("author"), F.lit("[unknown]"))
    return cleaned.groupBy(*CELL).agg(F.hll_sketch_agg(author, precision).alias("authors"))


def authors_in_spans(sketches: DataFrame, span: Column) -> DataFrame:
    """(asset, span, authors): estimated different authors over the weeks of each span, from their sketches alone."""
    merged = sketches.groupBy("asset", span.alias("span")).agg(F.hll_union_agg("authors").alias("_all"))
    return merged.select("asset", "span", F.hll_sketch_estimate("_all").alias("authors"))
