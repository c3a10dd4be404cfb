"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keep


def _smallest(pairs: DataFrame) -> DataFrame:
    """Every pair (u, v) with ``low``, the smallest of u and all its v; a hub's pairs are never gathered."""
    lows = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return pairs.join(lows, "u")


def _tangled(pairs: DataFrame) -> bool:
    """Whether pairs (u, v), v the smaller, are no stars yet: some u has several v or is one itself."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b longs): component is the smallest node reachable.

    Rounds are repeated until the links form stars, which takes about the logarithm of the longest
    chain. Null ends and self links add nothing; an empty table gives an empty result.
    """
    now = keep(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while _tangled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.union(now).where("u != v").distinct()
        small = _smallest(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        pairs = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v")))
        now = keep(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
