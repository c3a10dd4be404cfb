"""Posts and bars to the labelled weekly panel: one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tidemark.operators.market import weekly_market
from tidemark.operators.panel import join_text, label_weeks
from tidemark.operators.sentiment import PolarityRules, PredictorFactory
from tidemark.operators.terms import post_terms
from tidemark.operators.weekly_text import clean_posts, cleaned_text_features, weekly_text
from tidemark.session import use_utc
from tidemark.settings import StudySettings
from tidemark.sources.files import read_table, save_table


def weekly_panel(
    posts: DataFrame | None,
    bars: DataFrame,
    settings: StudySettings = StudySettings(),
    lexicon: Mapping[str, float] | DataFrame | None = None,
    factory: PredictorFactory | None = None,
    rules: PolarityRules = PolarityRules(),
    with_text: bool = False,
    cleaned: DataFrame | None = None,
) -> DataFrame:
    """One row per (asset, week) of the market, with text features and the label.

    The label is set on the market side, in the windows it has anyway, before the join.
    ``with_text`` adds the ``weekly_text`` string of every cell (cells that fit into a row);
    text models do not need it, they read ``weekly_terms``. Posts may be given cleaned.
    """
    use_utc(bars.sparkSession)
    text_settings, label = settings.text, settings.label
    if cleaned is None:
        cleaned = clean_posts(posts, settings.posts.min_text_length, settings.week_anchor)
    text = cleaned_text_features(
        cleaned,
        keyword_lexicon=text_settings.keyword_lexicon,
        backend=text_settings.sentiment_backend,
        lexicon=lexicon,
        factory=factory,
        batch_size=text_settings.model_batch_size,
        channels=text_settings.channels,
        rules=rules,
    )
    market = label_weeks(
        weekly_market(bars, settings.week_anchor),
        label.horizon_weeks, label.neutral_threshold, label.drop_neutral,
    )
    panel = join_text(market, text)
    if with_text:
        panel = join_text(panel, weekly_text(cleaned))
    return panel


def save_clean_posts(posts: DataFrame, path: str, settings: StudySettings = StudySettings()) -> DataFrame:
    """Write the cleaned posts once, as a parquet table, and read them back.

    Statistics, terms and pieces all start from cleaned text. Over a large corpus this is the
    costly step, so it is done once, without a shuffle; later counts and samples read its
    narrow columns only. Posts that landed in time order keep it, so weeks prune row groups.
    """
    spark = use_utc(posts.sparkSession)
    save_table(clean_posts(posts, settings.posts.min_text_length, settings.week_anchor), path)
    return read_table(spark, path)


def weekly_terms(
    posts: DataFrame | None = None,
    settings: StudySettings = StudySettings(),
    cleaned: DataFrame | None = None,
) -> DataFrame:
    """Term counts per (asset, week), from posts or from already cleaned ones."""
    if cleaned is None:
        use_utc(posts.sparkSession)
        cleaned = clean_posts(posts, settings.posts.min_text_length, settings.week_anchor)
    return post_terms(cleaned, settings.text.ngram_range)
