from __future__ import annotations

import pytest

from checks import all_oracles, all_queries
from checks.compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_agrees_with_its_sql(spark, name):
    verdict = compare(spark, FOLDER, name, all_queries()[name], all_oracles()[name])
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize(
    "name",
    ["tick_return", "daily_return", "term_counts", "weekly_text_pieces", "median_impute", "roc_auc_many_scores", "metrics_by_asset"],
)
def test_query_agrees_with_its_sql_when_cut_into_slices(spark, monkeypatch, name):
    from tidemark.operators import slices

    monkeypatch.setattr(slices.slice_bounds, "__defaults__", (100,))
    verdict = compare(spark, FOLDER, name, all_queries()[name], all_oracles()[name])
    assert verdict.startswith("ok"), verdict
