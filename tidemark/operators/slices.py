"""Ordered windows whose groups may be far larger than one task can sort.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. Here the
rows are first counted. Up to ``rows_per_slice`` rows the plain window is used. Beyond that
the full order (group columns first) is cut at sampled bounds, the window runs inside each
(group, slice), and one small row per (group, slice) carries the last value or the sum over
to the following slices. The bounds are literals in the plan, so a retried task puts every
row where the first attempt did, and the result is the same for any choice of bounds. Group
columns must not be null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 2_000_000
SAMPLES_PER_SLICE = 30
#: Sampled keys that the driver takes in all, about; with very many slices each has fewer of them.
SAMPLES = 200_000

Bounds = list[tuple]


def slice_bounds(
    df: DataFrame, order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE
) -> Bounds:
    """Sampled cut points of the order columns (numbers, strings, timestamps); none for a small input.

    The number of slices grows with the rows, so their size does not. The rows are counted and
    sampled here: give a table that is cheap to read twice.
    """
    keys = df.select(*order)
    rows = keys.count()
    slices = math.ceil(rows / rows_per_slice)
    if slices <= 1:
        return []
    wanted = max(2 * slices, min(slices * SAMPLES_PER_SLICE, SAMPLES))
    ordered = sorted(tuple(row) for row in keys.dropna().sample(min(1.0, wanted / rows), seed=17).collect())
    cuts = {ordered[len(ordered) * i // slices] for i in range(1, slices)} if ordered else set()
    return sorted(cuts)


_KINDS = {str: "string", int: "bigint", float: "double", datetime: "bigint"}


def _plain(value):
    """Timestamps as microseconds, other values as they are."""
    return int(value.replace(microsecond=0).timestamp()) * 1_000_000 + value.microsecond if isinstance(value, datetime) else value


def slice_of(order: Sequence[str], bounds: Bounds) -> Column:
    """Number of bounds at or below the row's key, found by halving a sorted array literal.

    The array is one JSON literal, so that planning does not depend on the number of bounds.
    """
    if not bounds:
        return F.lit(0)
    kinds = [_KINDS[type(v)] for v in bounds[0]]
    values = [
        F.unix_micros(F.col(name).cast("timestamp")) if isinstance(v, datetime) else F.col(name).cast(kind)
        for name, kind, v in zip(order, kinds, bounds[0])
    ]
    key = F.struct(*[value.alias(f"k{i}") for i, value in enumerate(values)])
    rows = json.dumps([{f"k{i}": _plain(v) for i, v in enumerate(bound)} for bound in bounds])
    table = F.from_json(F.lit(rows), f"array<struct<{','.join(f'k{i}:{kind}' for i, kind in enumerate(kinds))}>>")

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = F.struct(state["low"].alias("low"), middle.alias("high"))
        above = F.struct((middle + 1).alias("low"), state["high"].alias("high"))
        return F.when(state["low"] >= state["high"], state).when(key < F.get(table, middle), below).otherwise(above)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda state: state["low"])


BREAK = "\x00"


def constant_strings(words: Sequence[str]) -> Column:
    """Strings without U+0000 as one array that Catalyst folds into a literal; one call, whatever their number."""
    if any(BREAK in word for word in words):
        raise ValueError("a zero character cannot be part of a constant string")
    return F.split(F.lit(BREAK.join(words)), BREAK)


def place_of(value: Column, words: Sequence[str]) -> Column:
    """Place of a string in ``words``, sorted by code points, or -1; found by halving an array literal."""
    table = constant_strings(words)

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = F.struct(state["low"].alias("low"), middle.alias("high"))
        above = F.struct((middle + 1).alias("low"), state["high"].alias("high"))
        return F.when(state["low"] >= state["high"], state).when(F.get(table, middle) < value, above).otherwise(below)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(words)).alias("high"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(words).bit_length()))), start, halve, lambda state: state["low"])
    # The one-element array keeps the search from being computed for each mention.
    return F.transform(F.array(at), lambda i: F.when(F.get(table, i) == value, i).otherwise(-1))[0]


def previous_value(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "prev_",
    bounds: Bounds | None = None,
) -> DataFrame:
    """``lag(1)`` of ``values`` per group in ``order``, whatever the size of a group."""
    full_order = [*group, *order]
    if bounds is None:
        bounds = slice_bounds(df, full_order)
    if not bounds:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.select("*", *[F.lag(v).over(window).alias(f"{prefix}{v}") for v in values])

    sliced = df.withColumn("_slice", slice_of(full_order, bounds))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    lagged = sliced.select(
        "*",
        F.row_number().over(inside).alias("_row"),
        *[F.lag(v).over(inside).alias(f"{prefix}{v}") for v in values],
    )
    last = sliced.groupBy(*group, "_slice").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*group).orderBy("_slice")
    carry = last.select(*group, "_slice", F.lag("_last").over(across).alias("_carry"))
    joined = lagged.join(carry, [*group, "_slice"], "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("_row") == 1, F.col(f"_carry.{v}"))
            .otherwise(F.col(f"{prefix}{v}"))
            .alias(f"{prefix}{v}")
            for v in values
        ],
    )


def sum_before(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "before_",
    bounds: Bounds | None = None,
) -> DataFrame:
    """Sum of ``values`` over the rows before each row of its group, whatever the group's size."""
    full_order = [*group, *order]
    if bounds is None:
        bounds = slice_bounds(df, full_order)
    earlier = (Window.unboundedPreceding, -1)
    if not bounds:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(*earlier)
        return df.select(
            "*",
            *[F.coalesce(F.sum(v).over(window), F.lit(0)).alias(f"{prefix}{v}") for v in values],
        )

    sliced = df.withColumn("_slice", slice_of(full_order, bounds))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(*earlier)
    local = sliced.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values]
    )
    totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(v).alias(v) for v in values])
    across = Window.partitionBy(*group).orderBy("_slice").rowsBetween(*earlier)
    base = totals.select(
        *group, "_slice",
        *[F.coalesce(F.sum(v).over(across), F.lit(0)).alias(f"_base_{v}") for v in values],
    )
    return local.join(base, [*group, "_slice"], "left").select(
        *df.columns,
        *[(F.col(f"_in_{v}") + F.col(f"_base_{v}")).alias(f"{prefix}{v}") for v in values],
    )
