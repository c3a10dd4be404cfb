"""Weeks, months and epoch conversions. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A week named after the day it ends on, and how many days its first day lies
# after Monday.
WEEK_ANCHORS = {
    "W-SUN": 0, "W-MON": 1, "W-TUE": 2, "W-WED": 3, "W-THU": 4, "W-FRI": 5, "W-SAT": 6, "W": 0,
}


def week_start(ts: Column, anchor: str = "W-SUN") -> Column:
    """First instant of the week that holds ``ts``; ``W-SUN`` weeks run Monday to Sunday."""
    if anchor not in WEEK_ANCHORS:
        raise ValueError(f"unknown week anchor: {anchor}")
    shift = F.make_dt_interval(F.lit(WEEK_ANCHORS[anchor]))
    return (F.date_trunc("week", ts.cast("timestamp") - shift) + shift).cast("timestamp")


def epoch_seconds(value: Column) -> Column:
    return F.timestamp_seconds(value)


def epoch_millis(value: Column) -> Column:
    return F.timestamp_millis(value.cast("long"))


def iso_utc(value: Column) -> Column:
    """ISO text to timestamp; without an offset it means UTC. Bad text gives null."""
    return F.try_to_timestamp(value)


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar months from the month of ``start`` to ``end``; the last one stops at ``end``.

    The first window is not cut at ``start``: it begins on the first of that month.
    """
    bounds = spark.range(1).select(
        F.to_timestamp(F.lit(start)).alias("first"), F.to_timestamp(F.lit(end)).alias("last")
    )
    return add_month_windows(bounds, "first", "last")


def add_month_windows(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per calendar month of each ``[first, last)`` row of ``bounds``."""
    month = F.make_ym_interval(F.lit(0), F.lit(1))
    begins = F.when(
        F.date_trunc("month", F.col(first)) < F.col(last),
        F.sequence(
            F.date_trunc("month", F.col(first)), F.col(last) - F.expr("INTERVAL '1' MICROSECOND"), month
        ),
    )
    others = [c for c in bounds.columns if c not in (first, last)]
    return (
        bounds.select(*others, F.col(last), F.explode(begins).alias("window_start"))
        .select(
            *others, "window_start",
            F.least(F.col("window_start") + month, F.col(last)).alias("window_end"),
        )
    )
