"""Steps of a study as submitted jobs: ``spark-submit --py-files ... tidemark/jobs.py <step> ...``.

``land-posts`` and ``land-bars`` turn landed files into the posts and bars tables, ``panel`` builds the
weekly panel and the weekly terms, ``train`` validates and fits, ``per-asset`` and ``robustness`` repeat
that, ``lexicon-comparison`` does so with another lexicon, ``report`` and ``compare`` write tables.
Settings come from a JSON file with the fields of ``StudySettings``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.experiments import compare_experiments, robustness_study, save_asset_study, train_per_asset
from tidemark.plans.panel import save_clean_posts, weekly_panel, weekly_terms
from tidemark.plans.reports import save_report_tables
from tidemark.plans.training import save_results, train_and_evaluate
from tidemark.schemas import BARS, LEXICON, MODEL_METRICS, POSTS, PREDICTIONS, RAW_COMMENTS, RAW_POSTS
from tidemark.session import use_utc
from tidemark.settings import StudySettings, study_settings
from tidemark.sources.bars import normalize_close_series, normalize_klines, union_market
from tidemark.sources.files import read_table, save_table, spread
from tidemark.sources.posts import collect_archive, collect_search


def _table(spark: SparkSession, path: str, schema=None):
    return read_table(spark, path, schema if path.endswith(".csv") else None)


def _by_name(spark: SparkSession, path: str, schema: StructType):
    """A saved table with the types of a schema; CSV columns are found by their names, without a type scan."""
    rows = spark.read.csv(path, header=True) if path.endswith(".csv") else read_table(spark, path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in rows.columns])


def _landed(spark: SparkSession, path: str, schema: StructType):
    return spark.read.schema(schema).json(path) if path.endswith(".json") else read_table(spark, path)


def land_posts(spark: SparkSession, args, settings: StudySettings) -> None:
    """Landed submissions (and comments) to the posts table, by the settings' assets, span and source."""
    raw = _landed(spark, args.raw, RAW_POSTS)
    if settings.source == "archive":
        found = collect_archive(raw, settings.assets, settings.start, settings.end, settings.posts)
    else:
        comments = _landed(spark, args.comments, RAW_COMMENTS) if args.comments else None
        found = collect_search(raw, settings.assets, settings.start, settings.end, comments, settings.posts)
    save_table(found, f"{args.out}/posts.parquet", ["asset", "created_utc", "source_id"])


def land_bars(spark: SparkSession, args, settings: StudySettings) -> None:
    """One landed file per asset to the bars table: exchange records (JSON) or a (date, close) series (CSV)."""
    tickers = {q.asset: q.ticker or q.asset for q in settings.assets}
    sources = []
    for asset, path in (pair.split("=", 1) for pair in args.series):
        if path.endswith(".json"):
            bars = normalize_klines(spark.read.schema("bar array<string>").json(path))
        else:
            bars = normalize_close_series(spark.read.csv(path, header=True), settings.start, settings.end)
        sources.append((asset, tickers.get(asset, asset), bars))
    save_table(union_market(spark, sources), f"{args.out}/bars.parquet", ["asset", "date"])


def _save_panel(spark: SparkSession, posts, bars, settings: StudySettings, out: str, lexicon=None) -> None:
    """The labelled panel, and beside it the one that keeps neutral weeks, which other thresholds need."""
    cleaned = save_clean_posts(posts, f"{out}/clean_posts.parquet", settings)
    undropped = replace(settings, label=replace(settings.label, drop_neutral=False))
    save_table(weekly_panel(None, bars, undropped, lexicon=lexicon, cleaned=cleaned), f"{out}/weekly_panel_all.parquet", ["asset", "week_start"])
    every = read_table(spark, f"{out}/weekly_panel_all.parquet")
    kept = every.where(F.col("target_up").isNotNull()) if settings.label.drop_neutral else every
    save_table(kept, f"{out}/weekly_panel.parquet", ["asset", "week_start"])
    save_table(weekly_terms(settings=settings, cleaned=cleaned), f"{out}/weekly_terms.parquet")


def _lexicon(spark: SparkSession, args):
    return _by_name(spark, args.lexicon, LEXICON) if args.lexicon else None


def panel(spark: SparkSession, args, settings: StudySettings) -> None:
    posts = spread(_table(spark, args.posts, POSTS))
    _save_panel(spark, posts, _table(spark, args.bars, BARS), settings, args.out, _lexicon(spark, args))


def lexicon_comparison(spark: SparkSession, args, settings: StudySettings) -> None:
    """The study again with the given lexicon table, trained and compared with the one of the panel folder."""
    base = f"{args.panel}"
    again = f"{args.out}/with_lexicon"
    posts = spread(_table(spark, args.posts, POSTS))
    _save_panel(spark, posts, _table(spark, args.bars, BARS), settings, again, _lexicon(spark, args))
    metrics = {}
    for name, folder in (("sample lexicon", base), ("given lexicon", again)):
        weekly, terms = (read_table(spark, f"{folder}/{table}.parquet") for table in ("weekly_panel", "weekly_terms"))
        metrics[name] = train_and_evaluate(weekly, settings, terms).test_metrics
    save_table(compare_experiments(metrics), f"{args.out}/reports/lexicon_comparison.csv")


def _inputs(spark: SparkSession, args):
    folder = args.panel
    return read_table(spark, f"{folder}/weekly_panel.parquet"), read_table(spark, f"{folder}/weekly_terms.parquet")


def train(spark: SparkSession, args, settings: StudySettings) -> None:
    weekly, terms = _inputs(spark, args)
    save_results(train_and_evaluate(weekly, settings, terms), f"{args.out}/reports", f"{args.out}/models")


def per_asset(spark: SparkSession, args, settings: StudySettings) -> None:
    weekly, terms = _inputs(spark, args)
    study = train_per_asset(weekly, settings, terms)
    save_asset_study(study, f"{args.out}/reports/per_asset", f"{args.out}/models/per_asset")


def robustness(spark: SparkSession, args, settings: StudySettings) -> None:
    _, terms = _inputs(spark, args)
    weekly = read_table(spark, f"{args.panel}/weekly_panel_all.parquet")
    save_table(robustness_study(weekly, settings, terms), f"{args.out}/reports/robustness_summary.csv")


def report(spark: SparkSession, args, settings: StudySettings) -> None:
    weekly, _ = _inputs(spark, args)
    predictions = _by_name(spark, f"{args.out}/reports/predictions_test.csv", PREDICTIONS)
    save_report_tables(_table(spark, args.posts, POSTS), weekly, predictions, f"{args.out}/reports/final", settings)


def compare(spark: SparkSession, args, settings: StudySettings) -> None:
    tables = {name: _by_name(spark, path, MODEL_METRICS) for name, path in (pair.split("=", 1) for pair in args.metrics)}
    save_table(compare_experiments(tables), f"{args.out}/reports/sentiment_comparison.csv")


STEPS = {
    "land-posts": land_posts, "land-bars": land_bars, "lexicon-comparison": lexicon_comparison, "panel": panel, "train": train, "per-asset": per_asset, "robustness": robustness, "report": report,
    "compare": compare,
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=sorted(STEPS))
    parser.add_argument("--posts", help="posts table (.parquet or .csv)")
    parser.add_argument("--bars", help="daily bars table (.parquet or .csv)")
    parser.add_argument("--raw", help="landed submissions (.json lines, .parquet)")
    parser.add_argument("--comments", help="landed comments (.json lines, .parquet)")
    parser.add_argument("--series", nargs="*", default=[], help="asset=path of landed bars (.json records, .csv date and close)")
    parser.add_argument("--lexicon", help="(token, valence) table (.parquet or .csv)")
    parser.add_argument("--panel", help="output folder of the panel step")
    parser.add_argument("--metrics", nargs="*", default=[], help="name=path of holdout metric tables to compare")
    parser.add_argument("--settings", help="JSON file with settings")
    parser.add_argument("--out", required=True, help="folder to write to")
    args = parser.parse_args(arguments)
    settings = StudySettings()
    if args.settings:
        with open(args.settings, encoding="utf-8") as file:
            settings = study_settings(json.load(file))
    session = use_utc(spark or SparkSession.builder.appName("tidemark").getOrCreate())
    STEPS[args.step](session, args, settings)


if __name__ == "__main__":
    main()
