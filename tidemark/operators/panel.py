"""Weekly panel: market left-joined to text, with a forward label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import direction, persistence


def join_text(market: DataFrame, text: DataFrame) -> DataFrame:
    """Every market week, with its text features; a week without posts has zeros and no text.

    Both sides hold one row per (asset, week), so the join cannot fan out.
    """
    joined = market.join(text, ["asset", "week_start"], "left")
    filled = {
        c: "" if t == "string" else 0.0
        for c, t in text.dtypes
        if c not in ("asset", "week_start") and t in ("string", "double", "bigint", "int")
    }
    return joined.na.fill(filled) if filled else joined


def label_weeks(
    weekly: DataFrame,
    horizon_weeks: int = 1,
    neutral_threshold: float = 0.002,
    drop_neutral: bool = True,
) -> DataFrame:
    """Adds the weekly return ``horizon_weeks`` rows ahead, its direction and the persistence signal.

    Weeks without a future return drop out. Without ``drop_neutral`` a neutral week stays,
    with a null label.
    """
    by_asset = Window.partitionBy("asset").orderBy("week_start")
    labelled = weekly.withColumn(
        "future_return_h", F.lead("mkt_ret_1w", horizon_weeks).over(by_asset)
    ).where(F.col("future_return_h").isNotNull())
    labelled = labelled.withColumns(
        {
            "target_up": direction(F.col("future_return_h"), neutral_threshold),
            "naive_persistence_signal": persistence(F.col("mkt_ret_1w")),
        }
    )
    return labelled.where(F.col("target_up").isNotNull()) if drop_neutral else labelled


def relabel(panel: DataFrame, neutral_threshold: float) -> DataFrame:
    """The label for another threshold; neutral weeks always drop out.

    Weeks the panel lost to an earlier threshold do not come back: give the panel built with
    ``drop_neutral=False`` to have them.
    """
    return panel.withColumn(
        "target_up", direction(F.col("future_return_h"), neutral_threshold)
    ).where(F.col("target_up").isNotNull())
