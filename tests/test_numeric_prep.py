from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import numeric_prep as N


def frame(seed=4, rows=300):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "g": rng.integers(0, 3, rows).astype(str), "a": np.round(rng.normal(size=rows), 1),
        "b": np.where(rng.random(rows) < 0.4, 0.0, rng.random(rows)), "c": rng.integers(0, 5, rows).astype(float),
        "none": np.nan, "flat": 2.0,
    })
    df.loc[::7, "a"] = np.nan
    return df


def to_spark(spark, df):
    clean = df.astype(object).where(df.notna(), None)
    return spark.createDataFrame(list(clean.itertuples(index=False, name=None)), "g string, a double, b double, c double, none double, flat double")


@pytest.mark.parametrize("bounds", [None, [("0", "a", 0.0), ("0", "b", 0.3), ("1", "a", -0.5), ("1", "c", 2.0), ("2", "b", 0.0)]])
def test_exact_medians_per_group(spark, bounds):
    df = frame()
    got = {(r["g"], r["column_name"]): r["median"] for r in N.exact_medians(to_spark(spark, df), ["a", "b", "c", "none"], ["g"], bounds).collect()}
    expected = {(g, c): part[c].median() for g, part in df.groupby("g") for c in ("a", "b", "c")}
    assert got == pytest.approx(expected)


def test_even_count_takes_the_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert N.exact_medians(df, ["x"]).first()["median"] == 1.5


@pytest.mark.parametrize("n_train", [300, None])
def test_impute_and_scale(spark, n_train):
    df = frame()
    prep = N.fit_numeric(to_spark(spark, df), ["a", "b", "none", "flat"], n_train)
    assert prep.columns == ["a", "b", "flat"]
    filled = df["a"].fillna(df["a"].median())
    assert prep.medians["a"] == df["a"].median()
    assert prep.means["a"] == pytest.approx(filled.mean())
    assert prep.deviations["a"] == pytest.approx(filled.std(ddof=0))
    out = prep.transform(to_spark(spark, df)).toPandas()
    assert out["std_a"].mean() == pytest.approx(0.0, abs=1e-9)
    assert out["std_a"].std(ddof=0) == pytest.approx(1.0)
    assert (out["std_flat"] == 0).all()


def test_numeric_columns_leave_out_keys_text_and_label(spark):
    df = spark.createDataFrame([], "asset string, week_start timestamp, weekly_text string, future_return_h double, target_up int, mkt_ret_1w double, naive_persistence_signal int, post_count long")
    assert N.numeric_columns(df) == ["mkt_ret_1w", "naive_persistence_signal", "post_count"]


def test_no_usable_column(spark):
    with pytest.raises(ValueError):
        N.fit_numeric(to_spark(spark, frame()), ["none"], 10)
