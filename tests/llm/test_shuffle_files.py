"""Shuffle files of the many small steps of near-duplicate removal go with their step."""

from __future__ import annotations

import gc

from tidemark.llm.near_dedup import near_duplicates


def test_shuffle_files_go_with_their_step(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return sum(disk.getAllFiles().apply(k).getName().startswith("shuffle_") for k in range(disk.getAllFiles().size()))

    rows = [(k, " ".join(f"w{k // 8}_{j}" for j in range(60)) + f" tail{k % 8}") for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gc.collect()
    spark._jvm.System.gc()
    before = files()
    found = near_duplicates(docs)
    assert files() <= before
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {k: k // 8 * 8 for k, _ in rows}
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {k: k // 8 * 8 for k, _ in rows}
