"""Static schemas, so that a source with no rows still has every column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

POSTS = _struct(
    asset=_S, channel=_S, source_type=_S, source_id=_S, created_utc=_TS, author=_S,
    score=_L, num_comments=_L, text=_S, keyword=_S,
)

BARS = _struct(date=_TS, asset=_S, ticker=_S, open=_D, high=_D, low=_D, close=_D, volume=_D)

RAW_POSTS = _struct(
    id=_S, channel=_S, created_utc=_D, title=_S, body=_S, author=_S, score=_L, num_comments=_L,
)

RAW_COMMENTS = _struct(
    id=_S, post_id=_S, position=_L, created_utc=_D, body=_S, author=_S, score=_L,
)

PREDICTIONS = _struct(
    week_start=_TS, asset=_S, target_up=T.IntegerType(), model=_S, y_pred=T.IntegerType(), y_score=_D,
)


MODEL_METRICS = _struct(
    model=_S, asset=_S, accuracy=_D, balanced_accuracy=_D, precision=_D, recall=_D, f1=_D, roc_auc=_D,
    tn=_L, fp=_L, fn=_L, tp=_L, n_obs=_L,
)

LEXICON = _struct(token=_S, valence=_D)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
