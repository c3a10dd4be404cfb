"""Connected components end once the links are stars."""

from __future__ import annotations

from tidemark.llm import components as stars


def test_stars_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(stars, "keep", lambda df, name, plain=stars.keep: written.append(name) or plain(df, name))
    links = [(1, 5), (7, 1), (2, 9), (3, 3), (None, 4), (5, 1)]
    got = {r["node"]: r["component"] for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2}
    assert len(written) == 1


def test_tangled_links_become_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(50, 52), (51, 52), (53, 51)]
    got = {r["node"]: r["component"] for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 50 for k in range(50, 54)}
