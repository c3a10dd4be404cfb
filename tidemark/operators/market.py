"""Daily bars to weekly market features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_start
from tidemark.functions.numeric import change, finite
from tidemark.operators.slices import Bounds, previous_value

BAR_ORDER = ("date", "close", "open")


def tidy_bars(bars: DataFrame) -> DataFrame:
    """Timestamps and doubles, no row without asset or date; the ticker is optional."""
    prices = ("open", "high", "low", "close", "volume")
    return bars.select(
        "asset",
        F.col("date").cast("timestamp").alias("date"),
        *[finite(F.col(c).cast("double")).alias(c) for c in prices],
    ).where(F.col("asset").isNotNull() & F.col("date").isNotNull())


def daily_returns(bars: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Bars with ``daily_ret``: close over the asset's previous close, minus one."""
    keyed = tidy_bars(bars).withColumn("_at", F.unix_micros("date"))
    lagged = previous_value(
        keyed, ["asset"], ["_at", "close", "open"], ["close"], prefix="_prev_", bounds=bounds
    )
    return lagged.withColumn("daily_ret", change(F.col("close"), F.col("_prev_close"))).drop(
        "_at", "_prev_close"
    )


def weekly_bars(bars: DataFrame, anchor: str = "W-SUN") -> DataFrame:
    """One row per (asset, week): open, high, low, close, volume and volatility of daily returns.

    Bars are shuffled once, by (asset, week); a week holds at most seven daily bars. Returns
    inside the week are folded to count, mean and squared deviations. The one return that
    reaches back into the week before is added from the weekly rows, so no asset's whole
    history is sorted in one task.
    """
    in_week = Window.partitionBy("asset", "week_start").orderBy(*BAR_ORDER)
    position = F.struct(*BAR_ORDER)
    with_week = tidy_bars(bars).withColumn("week_start", week_start(F.col("date"), anchor))
    returns = with_week.withColumn(
        "_ret", change(F.col("close"), F.lag("close").over(in_week))
    )
    weekly = returns.groupBy("asset", "week_start").agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), position)).alias("mkt_open"),
        F.max("high").alias("mkt_high"),
        F.min("low").alias("mkt_low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), position)).alias("mkt_close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("mkt_volume"),
        F.count("_ret").alias("_n"),
        F.avg("_ret").alias("_mean"),
        (F.var_pop("_ret") * F.count("_ret")).alias("_m2"),
        F.min_by("close", position).alias("_first_close"),
        F.max_by("close", position).alias("_last_close"),
    )
    by_asset = Window.partitionBy("asset").orderBy("week_start")
    entry_ret = change(F.col("_first_close"), F.lag("_last_close").over(by_asset))
    joined = weekly.withColumn("_entry", entry_ret)
    extra = F.col("_entry").isNotNull().cast("int")
    gap = F.coalesce(F.col("_entry") - F.coalesce(F.col("_mean"), F.col("_entry")), F.lit(0.0))
    total = F.col("_n") + extra
    squares = F.coalesce(F.col("_m2"), F.lit(0.0)) + F.coalesce(
        F.try_divide(gap * gap * F.col("_n") * extra, total), F.lit(0.0)
    )
    volatility = F.when(total > 1, F.sqrt(squares / (total - 1))).otherwise(F.lit(0.0))
    return joined.select(
        "asset", "week_start", "mkt_open", "mkt_high", "mkt_low", "mkt_close", "mkt_volume",
        finite(volatility).alias("mkt_volatility_1w"),
    )


def weekly_returns(weekly: DataFrame) -> DataFrame:
    """Adds the weekly return, its three lags and the means of the 4 and 12 returns before it.

    Windows run over weekly rows, so a group is as long as the calendar, not as the data.
    """
    by_asset = Window.partitionBy("asset").orderBy("week_start")
    before = weekly.withColumn("_before", F.lag("mkt_close").over(by_asset))
    out = before.withColumn("mkt_ret_1w", finite(change(F.col("mkt_close"), F.col("_before")))).drop(
        "_before"
    )
    ret = F.col("mkt_ret_1w")

    def mean_before(k: int):
        span = by_asset.rowsBetween(-k, -1)
        return F.when(F.count(ret).over(span) == k, F.avg(ret).over(span))

    return out.select(
        "*",
        *[F.lag(ret, k).over(by_asset).alias(f"mkt_ret_lag{k}") for k in (1, 2, 3)],
        mean_before(4).alias("mkt_ret_roll4"),
        mean_before(12).alias("mkt_ret_roll12"),
    )


def weekly_market(bars: DataFrame, anchor: str = "W-SUN") -> DataFrame:
    return weekly_returns(weekly_bars(bars, anchor))
