"""Posts, bars, ticks and predictions derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import use_utc
from tidemark.sources.files import spread
from tidemark.settings import AssetQuery

ASSETS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CHANNELS = ("de", "en", "es", "fr")
KEYWORDS = ("the", "of", "de", "and", "la", "der", "que", "und", "tion")
LEXICON = {
    "the": 0.8, "of": -0.5, "de": 0.6, "and": -0.9, "la": 1.1, "der": -1.2, "que": 0.7, "und": -0.4,
    "les": 1.3, "for": -1.7, "that": 0.9, "is": 0.3, "el": -0.6, "die": 1.4, "in": -0.2,
}
UP_WORDS, DOWN_WORDS, NEGATIONS = ("re", "on", "en"), ("er", "un", "to"), ("le", "an", "es")
QUERIES = (
    AssetQuery("5-LOW", ("en", "fr"), ("the", "tion")),
    AssetQuery("1-URGENT", ("en", "de"), ("Of", "und", "er")),
    AssetQuery("3-MEDIUM", ("es",), ("que", "el")),
)
START, END = "1995-03-10", "1996-09-20"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(use_utc(spark).read.parquet(f"{folder}/{name}.parquet"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded at the very end (and no negative zero), so that summation order is no difference."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def dated(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_date(c) for c in columns or ("week_start",)})


def num(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


# Daily bars from orders: the priority is the asset, the orders of a day are its trades.


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("timestamp").alias("date")
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


BARS = """bars AS (
  SELECT o_orderpriority AS asset, o_orderdate AS date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY ALL)"""

DAILY = f"""{BARS},
daily AS (
  SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS daily_ret,
         CAST(date_trunc('week', date) AS DATE) AS week_start
  FROM bars)"""

WEEKLY = f"""{DAILY},
weekly AS (
  SELECT asset, week_start, arg_min(open, date) AS mkt_open, max(high) AS mkt_high, min(low) AS mkt_low,
         arg_max(close, date) AS mkt_close, coalesce(sum(volume), 0) AS mkt_volume,
         coalesce(stddev_samp(daily_ret), 0) AS mkt_volatility_1w
  FROM daily GROUP BY ALL),
returns AS (
  SELECT *, mkt_close / nullif(lag(mkt_close) OVER w, 0) - 1 AS mkt_ret_1w
  FROM weekly WINDOW w AS (PARTITION BY asset ORDER BY week_start)),
market AS (
  SELECT *, lag(mkt_ret_1w, 1) OVER w AS mkt_ret_lag1, lag(mkt_ret_1w, 2) OVER w AS mkt_ret_lag2,
         lag(mkt_ret_1w, 3) OVER w AS mkt_ret_lag3,
         CASE WHEN count(mkt_ret_1w) OVER w4 = 4 THEN avg(mkt_ret_1w) OVER w4 END AS mkt_ret_roll4,
         CASE WHEN count(mkt_ret_1w) OVER w12 = 12 THEN avg(mkt_ret_1w) OVER w12 END AS mkt_ret_roll12
  FROM returns
  WINDOW w AS (PARTITION BY asset ORDER BY week_start),
         w4 AS (PARTITION BY asset ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
         w12 AS (PARTITION BY asset ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
ahead AS (
  SELECT *, lead(mkt_ret_1w, 1) OVER (PARTITION BY asset ORDER BY week_start) AS future_return_h FROM market),
labelled AS (
  SELECT *, CASE WHEN future_return_h > 0.002 THEN 1 WHEN future_return_h < -0.002 THEN 0 END AS target_up,
         CASE WHEN mkt_ret_1w > 0 THEN 1 ELSE 0 END AS naive_persistence_signal
  FROM ahead WHERE future_return_h IS NOT NULL),
panel AS (SELECT * FROM labelled WHERE target_up IS NOT NULL)"""


# Posts from documents: language is the channel, ids give asset, time and author.


def posts(spark: SparkSession, folder: str) -> DataFrame:
    return posts_of(table(spark, folder, "documents"))


def posts_of(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id")
    hours = ((doc_id * 7919) % 17472).cast("int")
    return docs.select(
        F.element_at(F.array(*[F.lit(a) for a in ASSETS]), (doc_id % 5 + 1).cast("int")).alias("asset"),
        F.col("lang").alias("channel"),
        F.lit("submission").alias("source_type"),
        F.concat(F.lit("d"), doc_id.cast("string")).alias("source_id"),
        F.timestamp_add("HOUR", hours, F.lit("1995-01-01").cast("timestamp")).alias("created_utc"),
        F.when(doc_id % 13 != 0, F.concat(F.lit("u"), ((doc_id * 31) % 97).cast("string"))).alias("author"),
        (F.col("n_chars") % 100).alias("score"),
        (F.col("n_chars") % 17).alias("num_comments"),
        F.col("text"),
    )


_ASSET_LIST = "[" + ", ".join(f"'{a}'" for a in ASSETS) + "]"
# The cleaning rule step by step: links, characters to drop, runs of spaces.
URL_PATTERN = r"https?://[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+|www\.[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
DROP_PATTERN = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\p{Z}#@.$%+-]"
SPACES_PATTERN = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
CLEAN = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')),
  '{URL_PATTERN}', ' ', 'g'), '{DROP_PATTERN}', ' ', 'g'), '{SPACES_PATTERN}', ' ', 'g'))"""

POSTS = f"""posts AS (
  SELECT {_ASSET_LIST}[doc_id % 5 + 1] AS asset, lang AS channel, 'submission' AS source_type,
         'd' || doc_id AS source_id,
         TIMESTAMP '1995-01-01' + to_hours(CAST((doc_id * 7919) % 17472 AS INTEGER)) AS created_utc,
         CASE WHEN doc_id % 13 != 0 THEN 'u' || (doc_id * 31) % 97 END AS author,
         n_chars % 100 AS score, n_chars % 17 AS num_comments, text
  FROM documents),
cleaned AS (
  SELECT * FROM (
    SELECT * EXCLUDE (text), CAST(date_trunc('week', created_utc) AS DATE) AS week_start, {CLEAN} AS clean_text
    FROM posts)
  WHERE length(clean_text) >= 15)"""


def keyword_sum(column: str) -> str:
    return " + ".join(
        f"(length({column}) - length(replace({column}, '{k}', ''))) // {len(k)}" for k in KEYWORDS
    )


# Landed submissions from documents: the whole text is the title the queries look at.


def raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    doc_id = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.concat(F.lit("d"), doc_id.cast("string")).alias("id"),
        F.col("lang").alias("channel"),
        (F.lit(788918400) + ((doc_id * 7919) % 17472) * 3600).alias("created_utc"),
        F.col("text").alias("title"),
        F.when(doc_id % 3 != 0, F.col("source")).alias("body"),
        F.when(doc_id % 13 != 0, F.concat(F.lit("u"), ((doc_id * 31) % 97).cast("string"))).alias("author"),
        F.when(doc_id % 11 != 0, F.col("n_chars") % 100).alias("score"),
        (F.col("n_chars") % 17).alias("num_comments"),
    )


_EDGES = r"^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$"

RAW_POSTS = f"""normal AS (
  SELECT lang AS channel, 'submission' AS source_type, 'd' || doc_id AS source_id,
         TIMESTAMP '1995-01-01' + to_hours(CAST((doc_id * 7919) % 17472 AS INTEGER)) AS created_utc,
         CASE WHEN doc_id % 13 != 0 THEN 'u' || (doc_id * 31) % 97 ELSE '[deleted]' END AS author,
         CASE WHEN doc_id % 11 != 0 THEN n_chars % 100 ELSE 0 END AS score, n_chars % 17 AS num_comments,
         regexp_replace(coalesce(text, '') || ' ' || CASE WHEN doc_id % 3 != 0 THEN source ELSE '' END,
                        '{_EDGES}', '', 'g') AS text,
         coalesce(text, '') AS title
  FROM documents)"""

_QUERY_ROWS = ", ".join(
    f"('{q.asset}', '{c}', '{k}', {i * 10000 + ci * 100 + ki})"
    for i, q in enumerate(QUERIES)
    for ci, c in enumerate(q.channels)
    for ki, k in enumerate(q.keywords)
)
MATCHED = f"""{RAW_POSTS},
asked(asset, channel, keyword, query_no) AS (VALUES {_QUERY_ROWS}),
matched AS (
  SELECT n.*, a.asset, a.keyword, a.query_no FROM normal n JOIN asked a USING (channel)
  WHERE contains(lower(n.title), lower(a.keyword)))"""


# Comments from conversations: each conversation is a thread, each turn a comment.


def raw_comments(spark: SparkSession, folder: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), conv.cast("string"), F.lit("_"), turn.cast("string")).alias("id"),
        F.concat(F.lit("d"), conv.cast("string")).alias("post_id"),
        turn.alias("position"),
        (F.lit(788918400) + ((conv * 7919) % 17472) * 3600 + turn * 60).alias("created_utc"),
        F.when((conv + turn) % 7 != 0, F.col("text")).alias("body"),
        F.when(turn % 2 == 0, F.col("role")).alias("author"),
        (conv % 50).alias("score"),
    )


RAW_COMMENTS = """talk AS (
  SELECT 'c' || conv_id || '_' || turn AS id, 'd' || conv_id AS post_id, turn AS position,
         TIMESTAMP '1995-01-01' + to_hours(CAST((conv_id * 7919) % 17472 AS INTEGER))
           + to_minutes(CAST(turn AS INTEGER)) AS created_utc,
         CASE WHEN (conv_id + turn) % 7 != 0 THEN text ELSE '' END AS body,
         CASE WHEN turn % 2 = 0 THEN role ELSE '[deleted]' END AS author, conv_id % 50 AS score
  FROM conversations)"""


# Predictions of three models from labels, with tied scores and repeated keys.


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    doc_id = F.col("doc_id")
    no = F.col("no")
    hours = ((doc_id * 7919) % 17472).cast("int")
    at = F.timestamp_add("HOUR", hours, F.lit("1995-01-01").cast("timestamp"))
    return table(spark, folder, "labels").withColumn(
        "no", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    ).select(
        F.date_trunc("week", at).alias("week_start"),
        F.element_at(F.array(*[F.lit(a) for a in ASSETS]), (doc_id % 5 + 1).cast("int")).alias("asset"),
        F.col("quality").alias("target_up"),
        F.concat(F.lit("model_"), no.cast("string")).alias("model"),
        ((doc_id * 7 + no * 3) % 10 >= 5).cast("int").alias("y_pred"),
        F.when(no != 2, ((doc_id * 37 + no * 11) % 20) / F.lit(20.0)).alias("y_score"),
    )


PREDICTIONS = f"""predictions AS (
  SELECT CAST(date_trunc('week', TIMESTAMP '1995-01-01'
           + to_hours(CAST((doc_id * 7919) % 17472 AS INTEGER))) AS DATE) AS week_start,
         {_ASSET_LIST}[doc_id % 5 + 1] AS asset, quality AS target_up, 'model_' || no AS model,
         CASE WHEN (doc_id * 7 + no * 3) % 10 >= 5 THEN 1 ELSE 0 END AS y_pred,
         CASE WHEN no != 2 THEN ((doc_id * 37 + no * 11) % 20) / 20.0::DOUBLE END AS y_score
  FROM labels, (VALUES (0), (1), (2)) models(no)),
once AS (
  SELECT * FROM predictions
  QUALIFY row_number() OVER (PARTITION BY week_start, asset, model
                             ORDER BY y_pred, target_up, y_score NULLS FIRST) = 1)"""


def metrics_sql(source: str, keys: str) -> str:
    """CTEs ``counts``, ``area`` and ``metrics`` over a (target_up, y_pred, y_score) source."""
    return f"""counts AS (
  SELECT {keys}, count(*) FILTER (target_up = 0 AND y_pred = 0) AS tn,
         count(*) FILTER (target_up = 0 AND y_pred = 1) AS fp,
         count(*) FILTER (target_up = 1 AND y_pred = 0) AS fn,
         count(*) FILTER (target_up = 1 AND y_pred = 1) AS tp, count(*) AS n_obs,
         count(*) FILTER (y_score IS NULL) AS unscored
  FROM {source} GROUP BY ALL),
ranks AS (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY y_score)
            + (count(*) OVER (PARTITION BY {keys}, y_score) - 1) / 2.0::DOUBLE AS mid_rank
  FROM {source}),
area AS (
  SELECT {keys},
    (sum(mid_rank) FILTER (target_up = 1) - count(*) FILTER (target_up = 1)
       * (count(*) FILTER (target_up = 1) + 1) / 2.0::DOUBLE)
    / nullif(count(*) FILTER (target_up = 1) * count(*) FILTER (target_up = 0), 0) AS auc
  FROM ranks GROUP BY ALL),
metrics AS (
  SELECT {keys}, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy,
    (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0))
      / ((tp + fn > 0)::INT + (tn + fp > 0)::INT) AS balanced_accuracy,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
    CASE WHEN unscored = 0 THEN auc END AS roc_auc, tn, fp, fn, tp, n_obs
  FROM counts JOIN area USING ({keys}))"""


METRIC_COLUMNS = ", ".join(
    num(m, m) for m in ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc")
) + ", tn, fp, fn, tp"
