"""First, best and top-n rows per group, built so that a hot group never sits in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.slices import Bounds, slice_bounds, slice_of

#: Up to so many rows per group each map task keeps its own first rows; more are found by a threshold.
MAP_SIDE_ROWS = 1_000


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate, not a window: each map task keeps one row per key, so a key that a third
    of the rows share costs one row per task in the shuffle. Rows with equal order are
    settled by their remaining columns, so the result does not depend on the read order.
    """
    rest = [c for c in df.columns if c not in key]
    position = [column.alias(f"_order{i}") for i, column in enumerate(order)]
    kept = df.groupBy(*key).agg(F.min(F.struct(*position, *rest)).alias("_row"))
    return kept.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def best_per_group(df: DataFrame, group: Sequence[str], metric: str, tie: str) -> DataFrame:
    """The row with the highest metric per group; the smaller ``tie`` wins a draw, nulls lose."""
    return first_per_key(
        df, group, [F.col(metric).isNull(), -F.coalesce(F.col(metric), F.lit(0.0)), F.col(tie)]
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, lanes: int = 64
) -> DataFrame:
    """The first ``n`` rows of every group in ``order`` (which has to be total).

    Three levels: each map task keeps n rows per group, ``lanes`` tasks per group merge
    those, and one merge of at most ``n * lanes`` rows ends it. A map task belongs to one
    lane, and any spread over the lanes gives the same rows.
    """
    lane = Window.partitionBy(*group, "_lane").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_lane", F.spark_partition_id() % F.lit(lanes))
        .withColumn("_rank", F.row_number().over(lane))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= n)
        .drop("_lane", "_rank")
    )


def first_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, descending: Sequence[str] = (), bounds: Bounds | None = None,
    ties: Sequence[Column] = (),
) -> DataFrame:
    """The first ``n`` rows of every group by the columns ``order``, then ``ties`` (together total), for any ``n``.

    No group is ever sorted. The full order is cut at sampled bounds into slices of bounded size, and rows are
    counted per (group, slice), before any shuffle. A running sum over the slices names each group's
    boundary slice: slices before it are whole, and only the rows of the boundary slice are ranked.
    Columns in ``descending`` run from their largest value, by slices taken backwards: they have to be the
    first of ``order``, or all. Nulls come first, also in descending columns last. Group columns must not be
    null. Small inputs, and caps that map tasks can apply, take :func:`top_per_group`.
    """
    turned = [c in descending for c in order]
    if any(turned) and not all(turned):
        raise ValueError("descending columns have to be all of the order; negate numbers for a mixed one")
    ranks = [F.col(c).desc_nulls_last() if t else F.col(c).asc_nulls_first() for c, t in zip(order, turned)]
    ranks += list(ties)
    if n <= MAP_SIDE_ROWS:
        return top_per_group(df, group, ranks, n)
    if bounds is None:
        bounds = slice_bounds(df, [*group, *order])
    if not bounds:
        whole = Window.partitionBy(*group).orderBy(*ranks)
        return df.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n).drop("_rank")
    sliced = df.withColumn("_slice", slice_of([*group, *order], bounds))
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    across = Window.partitionBy(*group).orderBy(F.col("_slice").desc() if all(turned) else F.col("_slice"))
    before = F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Groups that need no cut have no boundary.
    cut = counts.withColumn("_before", before).where((F.col("_before") < n) & (F.col("_before") + F.col("_n") > n)).select(
        *group, F.col("_slice").alias("_cut"), (F.lit(n) - F.col("_before")).alias("_open")
    )
    joined = sliced.join(cut, list(group), "left")
    ahead = F.col("_slice") > F.col("_cut") if all(turned) else F.col("_slice") < F.col("_cut")
    # A group that fills up exactly at the end of a slice: later slices are beyond it.
    last = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy(*group).agg((F.min if all(turned) else F.max)("_slice").alias("_last"))
    inside = F.col("_slice") >= F.col("_last") if all(turned) else F.col("_slice") <= F.col("_last")
    kept = joined.join(last, list(group)).where(inside)
    whole_slices = kept.where(F.col("_cut").isNull() | ahead).select(*df.columns)
    boundary = kept.where(F.col("_slice") == F.col("_cut"))
    ranked = boundary.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*ranks)))
    return whole_slices.unionByName(ranked.where(F.col("_rank") <= F.col("_open")).select(*df.columns))


def latest_rows(
    df: DataFrame, group: Sequence[str], n: int = 40, when: str = "week_start"
) -> DataFrame:
    """The last ``n`` rows of every group by ``when``."""
    others = [F.col(c) for c in df.columns if c not in (*group, when)]
    return top_per_group(df, group, [F.col(when).desc(), *others], n)
