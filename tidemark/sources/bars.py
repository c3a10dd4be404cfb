"""Landed price series to the daily bars table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_millis
from tidemark.functions.numeric import as_number
from tidemark.schemas import BARS, empty

# Positions in the exchange's bar record (open time in ms, then prices and volume).
BAR_FIELDS = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5}


def normalize_klines(raw: DataFrame, column: str = "bar") -> DataFrame:
    """Exchange bar arrays to (date, open, high, low, close, volume).

    Text that is no number becomes null; a bar without date or close drops out.
    """
    fields = F.col(column)
    return raw.select(
        epoch_millis(F.get(fields, F.lit(0)).try_cast("long")).alias("date"),
        *[as_number(F.get(fields, F.lit(at))).alias(name) for name, at in BAR_FIELDS.items()],
    ).dropna(subset=["date", "close"])


def normalize_close_series(raw: DataFrame, start: str, end: str) -> DataFrame:
    """A (date, close) series to flat bars without volume, from ``start`` to before ``end``."""
    dated = raw.select(
        F.col("date").cast("timestamp").alias("date"), as_number(F.col("close")).alias("close")
    ).where(
        F.col("close").isNotNull()
        & (F.col("date") >= F.lit(start).cast("timestamp"))
        & (F.col("date") < F.lit(end).cast("timestamp"))
    )
    return dated.select(
        "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(0.0).alias("volume"),
    )


def union_market(
    spark: SparkSession, sources: Iterable[tuple[str, str, DataFrame | None]]
) -> DataFrame:
    """(asset, ticker, bars) sources as one table; a missing source is skipped."""
    tagged = [
        bars.select(
            F.col("date").cast("timestamp").alias("date"), F.lit(asset).alias("asset"),
            F.lit(ticker).alias("ticker"),
            *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        )
        for asset, ticker, bars in sources
        if bars is not None
    ]
    if not tagged:
        return empty(spark, BARS)
    return reduce(lambda a, b: a.unionByName(b), tagged)
