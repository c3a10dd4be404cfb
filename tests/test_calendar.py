from __future__ import annotations

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import epoch_millis, epoch_seconds, iso_utc, month_windows, week_start
from tidemark.functions.calendar import WEEK_ANCHORS


def test_week_start_equals_period_start_for_every_anchor(spark):
    times = pd.date_range("2023-12-20", periods=300, freq="7h")
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in times], "ts timestamp")
    for anchor in WEEK_ANCHORS:
        freq = "W-SUN" if anchor == "W" else anchor
        got = {r["ts"]: r["w"] for r in df.select("ts", week_start(F.col("ts"), anchor).alias("w")).collect()}
        assert got == {t.to_pydatetime(): t.to_period(freq).start_time.to_pydatetime() for t in times}
    with pytest.raises(ValueError):
        week_start(F.col("ts"), "W-XXX")


def test_week_turns_between_sunday_and_monday(spark):
    df = spark.createDataFrame([("2024-01-07 23:59:59",), ("2024-01-08 00:00:00",)], "s string")
    got = [r[0] for r in df.select(week_start(F.to_timestamp("s")).alias("w")).orderBy("w").collect()]
    assert got == [datetime(2024, 1, 1), datetime(2024, 1, 8)]


def test_month_windows_start_on_the_first_and_stop_at_the_end(spark):
    rows = month_windows(spark, "2024-01-15", "2024-03-10").orderBy("window_start").collect()
    assert [tuple(r) for r in rows] == [
        (datetime(2024, 1, 1), datetime(2024, 2, 1)),
        (datetime(2024, 2, 1), datetime(2024, 3, 1)),
        (datetime(2024, 3, 1), datetime(2024, 3, 10)),
    ]
    assert month_windows(spark, "2024-01-01", "2024-02-01").count() == 1
    assert month_windows(spark, "2024-02-01", "2024-02-01").count() == 0


def test_epochs_and_iso_text_are_utc(spark):
    row = spark.range(1).select(
        epoch_seconds(F.lit(86400)).alias("s"), epoch_millis(F.lit(86400500)).alias("m"),
        iso_utc(F.lit("2024-01-03T10:00:00Z")).alias("z"), iso_utc(F.lit("2024-01-03")).alias("d"),
        iso_utc(F.lit("2024-01-03T10:00:00+02:00")).alias("o"), iso_utc(F.lit("soon")).alias("bad"),
    ).first()
    assert row["s"] == datetime(1970, 1, 2)
    assert row["m"] == datetime(1970, 1, 2, 0, 0, 0, 500000)
    assert row["z"] == datetime(2024, 1, 3, 10)
    assert row["d"] == datetime(2024, 1, 3)
    assert row["o"] == datetime(2024, 1, 3, 8)
    assert row["bad"] is None
