"""Bars, weekly market features, labels and the joined panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.stand_ins import (
    ASSETS, BARS, CHANNELS, CLEAN, DAILY, KEYWORDS, POSTS, WEEKLY,
    bars, dated, keyword_sum, num, posts, rounded, table,
)
from tidemark.functions import persistence, week_start
from tidemark.operators import market as M
from tidemark.operators.panel import join_text, label_weeks, relabel
from tidemark.operators.weekly_text import clean_posts, weekly_stats
from tidemark.sources.bars import normalize_close_series, normalize_klines, union_market

ANCHORS = ("W-SUN", "W-MON", "W-TUE", "W-WED", "W-THU", "W-FRI", "W-SAT")


def week_bucket(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        "event_id", *[F.to_date(week_start(F.col("ts"), a)).alias(f"week_{a[2:].lower()}") for a in ANCHORS]
    )


WEEK_BUCKET = "SELECT event_id, " + ", ".join(
    f"CAST(date_trunc('week', ts - INTERVAL {k} DAY) + INTERVAL {k} DAY AS DATE) AS week_{a[2:].lower()}"
    for k, a in enumerate(ANCHORS)
) + " FROM events"


def daily_return(spark, folder):
    out = M.daily_returns(bars(spark, folder)).select("asset", "date", "close", "daily_ret")
    return rounded(dated(out, "date"))


def tick_return(spark, folder):
    ticks = table(spark, folder, "events").select(
        F.col("event_type").alias("asset"), F.col("ts").alias("date"),
        *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"),
    )
    out = M.daily_returns(ticks).groupBy("asset").agg(
        F.count("*").alias("ticks"), F.count("daily_ret").alias("returns"),
        F.avg("daily_ret").alias("mean_ret"), F.max("daily_ret").alias("max_ret"),
    )
    return rounded(out)


TICK_RETURN = f"""WITH r AS (
  SELECT event_type AS asset, value / nullif(lag(value) OVER (PARTITION BY event_type ORDER BY ts, value), 0) - 1 AS ret
  FROM events)
SELECT asset, count(*) AS ticks, count(ret) AS returns, {num('avg(ret)', 'mean_ret')}, {num('max(ret)', 'max_ret')}
FROM r GROUP BY ALL"""

OHLCV = ("mkt_open", "mkt_high", "mkt_low", "mkt_close", "mkt_volume", "mkt_volatility_1w")
RETURNS = ("mkt_ret_1w", "mkt_ret_lag1", "mkt_ret_lag2", "mkt_ret_lag3", "mkt_ret_roll4", "mkt_ret_roll12")


def weekly_ohlcv(spark, folder):
    return rounded(dated(M.weekly_bars(bars(spark, folder))))


def weekly_returns(spark, folder):
    return rounded(dated(M.weekly_market(bars(spark, folder)).select("asset", "week_start", *RETURNS)))


def market_panel(spark, folder, drop_neutral=True):
    return label_weeks(M.weekly_market(bars(spark, folder)), drop_neutral=drop_neutral)


def forward_label(spark, folder):
    out = market_panel(spark, folder, drop_neutral=False)
    return rounded(dated(out.select("asset", "week_start", "future_return_h", "target_up")))


def persistence_signal(spark, folder):
    weekly = M.weekly_market(bars(spark, folder))
    return dated(weekly.select("asset", "week_start", persistence(F.col("mkt_ret_1w")).alias("signal")))


def relabel_counts(spark, folder):
    out = relabel(market_panel(spark, folder, drop_neutral=False), 0.05)
    return out.groupBy("asset", "target_up").agg(F.count("*").alias("weeks"))


def weekly_text(spark, folder):
    return weekly_stats(clean_posts(posts(spark, folder)), KEYWORDS, CHANNELS)


def weekly_panel(spark, folder):
    panel = join_text(market_panel(spark, folder), weekly_text(spark, folder))
    return rounded(dated(panel))


TEXT_NUMBERS = {
    "post_count": "count(source_id)",
    "post_unique_authors": "count(DISTINCT coalesce(author, '[unknown]'))",
    "post_score_sum": "sum(score)",
    "post_score_mean": "avg(score)",
    "post_comments_sum": "sum(num_comments)",
    "post_comments_mean": "avg(num_comments)",
    "post_text_len_mean": "avg(length(clean_text))",
    "post_keyword_hits_sum": f"sum({keyword_sum('clean_text')})",
    "post_channel_nunique": "count(DISTINCT channel)",
    **{f"post_channel_{c}_count": f"count(*) FILTER (channel = '{c}')" for c in CHANNELS},
}
TEXT_STATS = f"""{POSTS},
stats AS (SELECT asset, week_start, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in TEXT_NUMBERS.items())}
  FROM cleaned GROUP BY asset, week_start)"""

WEEKLY_PANEL = f"""WITH {WEEKLY}, {TEXT_STATS}
SELECT p.asset, p.week_start, {', '.join(num(f'p.{c}', c) for c in (*OHLCV, *RETURNS, 'future_return_h'))},
  p.target_up, p.naive_persistence_signal, {', '.join(num(f'coalesce(s.{c}, 0)', c) for c in TEXT_NUMBERS)}
FROM panel p LEFT JOIN stats s USING (asset, week_start)"""


def klines(spark, folder):
    """Bars as exchange records (text fields, some of them broken), then read back."""
    prices = bars(spark, folder).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    broken = F.col("day") % 17 == 0
    text = [F.col(c).cast("string") for c in ("open", "high", "low")]
    record = F.array(
        (F.unix_millis("date")).cast("string"), *text,
        F.when(broken, F.lit("n/a")).otherwise(F.col("close").cast("string")),
        F.when(F.col("day") % 5 == 0, F.lit("")).otherwise(F.col("volume").cast("string")),
        *[F.lit("0") for _ in range(6)],
    )
    out = normalize_klines(prices.select("asset", record.alias("bar")).withColumn("bar", F.col("bar")))
    return rounded(dated(out, "date"))


KLINES = f"""WITH {BARS}
SELECT CAST(date AS DATE) AS date, {', '.join(num(c, c) for c in ('open', 'high', 'low', 'close'))},
  {num("CASE WHEN datediff('day', DATE '1970-01-01', CAST(date AS DATE)) % 5 != 0 THEN volume END", 'volume')}
FROM bars WHERE datediff('day', DATE '1970-01-01', CAST(date AS DATE)) % 17 != 0"""


def _series(spark, folder, asset):
    daily = bars(spark, folder).where(F.col("asset") == asset)
    day = F.dayofmonth("date")
    return daily.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.when(day % 7 == 0, F.lit(".")).otherwise(F.col("close").cast("string")).alias("close"),
    )


def _flat(spark, folder, asset):
    return normalize_close_series(_series(spark, folder, asset), "1996-01-01", "1998-01-01")


def close_series(spark, folder):
    """Each asset's closes are a series of their own."""
    flat = [_flat(spark, folder, a).withColumn("asset", F.lit(a)) for a in ASSETS]
    return rounded(dated(reduce(lambda x, y: x.unionByName(y), flat), "date"))


_CLOSES = f"""SELECT asset, CAST(date AS DATE) AS date, {', '.join(num('close', c) for c in ('open', 'high', 'low', 'close'))},
  CAST(0 AS DOUBLE) AS volume
FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01' AND day(date) % 7 != 0"""


def market_union(spark, folder):
    """Full bars of three assets, close series of two, and one source that found nothing."""
    full = [(a, f"{a}-USD", bars(spark, folder).where(F.col("asset") == a).drop("asset")) for a in ASSETS[:3]]
    flat = [(a, f"{a}_PROXY", _flat(spark, folder, a)) for a in ASSETS[3:]]
    return rounded(dated(union_market(spark, [*full, *flat, ("none", "NONE", None)]), "date"))


_FULL = ", ".join(f"'{a}'" for a in ASSETS[:3])
MARKET_UNION = f"""WITH {BARS}, flat AS ({_CLOSES})
SELECT CAST(date AS DATE) AS date, asset, asset || '-USD' AS ticker,
  {', '.join(num(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars WHERE asset IN ({_FULL})
UNION ALL SELECT date, asset, asset || '_PROXY', open, high, low, close, volume FROM flat WHERE asset NOT IN ({_FULL})"""


QUERIES = {
    "week_bucket": week_bucket,
    "daily_return": daily_return,
    "tick_return": tick_return,
    "weekly_ohlcv": weekly_ohlcv,
    "weekly_returns": weekly_returns,
    "forward_label": forward_label,
    "persistence": persistence_signal,
    "relabel_counts": relabel_counts,
    "weekly_panel": weekly_panel,
    "normalize_klines": klines,
    "close_series": close_series,
    "union_market": market_union,
}

ORACLES = {
    "week_bucket": WEEK_BUCKET,
    "daily_return": f"""WITH {DAILY}
SELECT asset, CAST(date AS DATE) AS date, {num('close', 'close')}, {num('daily_ret', 'daily_ret')} FROM daily""",
    "tick_return": TICK_RETURN,
    "weekly_ohlcv": f"WITH {WEEKLY} SELECT asset, week_start, {', '.join(num(c, c) for c in OHLCV)} FROM weekly",
    "weekly_returns": f"WITH {WEEKLY} SELECT asset, week_start, {', '.join(num(c, c) for c in RETURNS)} FROM market",
    "forward_label": f"""WITH {WEEKLY}
SELECT asset, week_start, {num('future_return_h', 'future_return_h')}, target_up FROM labelled""",
    "persistence": f"""WITH {WEEKLY}
SELECT asset, week_start, CASE WHEN mkt_ret_1w > 0 THEN 1 ELSE 0 END AS signal FROM market""",
    "relabel_counts": f"""WITH {WEEKLY}
SELECT asset, CASE WHEN future_return_h > 0.05 THEN 1 ELSE 0 END AS target_up, count(*) AS weeks
FROM labelled WHERE abs(future_return_h) > 0.05 GROUP BY ALL""",
    "weekly_panel": WEEKLY_PANEL,
    "normalize_klines": KLINES,
    "close_series": f"WITH {BARS} {_CLOSES}",
    "union_market": MARKET_UNION,
}
