"""Numbers, labels and shares as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_number(value: Column) -> Column:
    """Double, or null where the text is no number."""
    return finite(value.try_cast("double"))


def finite(value: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def known(value: Column) -> Column:
    """The value as a double; NaN counts as missing."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def change(value: Column, previous: Column) -> Column:
    """Relative change; null where the earlier value is null or zero."""
    return F.try_divide(value, previous) - F.lit(1.0)


def direction(future_return: Column, threshold: float) -> Column:
    """1 above the threshold, 0 below its negative, null between (both ends included)."""
    return F.when(future_return > F.lit(threshold), F.lit(1)).when(
        future_return < F.lit(-threshold), F.lit(0)
    )


def persistence(weekly_return: Column) -> Column:
    """Says the next week repeats the sign of the last; no return counts as not up."""
    return F.coalesce((weekly_return > 0).cast("int"), F.lit(0))


def sign_flags(score: Column, cut: float = 0.05) -> tuple[Column, Column]:
    """Strictly positive and strictly negative flags as 1.0 / 0.0; null counts as neither."""
    up = F.coalesce((score > F.lit(cut)).cast("double"), F.lit(0.0))
    down = F.coalesce((score < F.lit(-cut)).cast("double"), F.lit(0.0))
    return up, down


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def share(part: Column, total: Column) -> Column:
    """part / total, 0 where total is 0."""
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))
