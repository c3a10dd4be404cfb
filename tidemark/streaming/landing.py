"""The stateless steps on a stream of landed submission files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.weekly_text import clean_posts
from tidemark.schemas import RAW_POSTS
from tidemark.session import use_utc
from tidemark.settings import AssetQuery
from tidemark.sources.posts import match_posts, normalize_posts


def matched_stream(
    spark: SparkSession, folder: str, queries: Sequence[AssetQuery], min_text_length: int = 15,
    anchor: str = "W-SUN", files_per_batch: int = 1000,
) -> DataFrame:
    """Cleaned posts, one row per query met, from JSON files as they land in a folder."""
    use_utc(spark)
    raw = (
        spark.readStream.schema(RAW_POSTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )
    matched = match_posts(normalize_posts(raw), queries).drop("query_no")
    return clean_posts(matched, min_text_length, anchor)


def land_posts(matched: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append matched posts to a parquet table laid out by week; caps and dedup read that table."""
    writer = (
        matched.withColumn("week", F.to_date("week_start"))
        .writeStream.format("parquet")
        .partitionBy("week")
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(table)


def weekly_volume(posts: DataFrame, delay: str = "14 days") -> DataFrame:
    """(week_start, asset, posts) of a stream of posts, each (asset, source_id) counted once.

    Weeks are by event time and begin on Monday. Posts later than ``delay`` behind the newest one are left out, and
    a repeated post is known as long; both bound the state, which lies spread by asset and id, then by week and asset.
    """
    timed = posts.where(F.col("asset").isNotNull() & F.col("created_utc").isNotNull()).withWatermark("created_utc", delay)
    once = timed.dropDuplicatesWithinWatermark(["asset", "source_id"])
    # Windows of seven days count from a Thursday, 1970-01-01.
    week = F.window("created_utc", "7 days", startTime="4 days")
    return once.groupBy(week, "asset").agg(F.count("*").alias("posts")).select(F.col("window.start").alias("week_start"), "asset", "posts")


def land_volume(volume: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch's changed counts to a parquet table; a repeated batch replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = volume.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def landed_volume(spark: SparkSession, table: str) -> DataFrame:
    """The latest count of each (week, asset): counts only grow, so it is the largest."""
    return spark.read.parquet(table).groupBy("week_start", "asset").agg(F.max("posts").alias("posts"))
