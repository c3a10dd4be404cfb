"""Exact medians, imputation and scaling of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import known
from tidemark.operators.slices import Bounds, slice_bounds, sum_before

SMALL_BLOCK = 100_000
NOT_FEATURES = {"asset", "week_start", "weekly_text", "future_return_h", "target_up"}


def numeric_columns(panel: DataFrame) -> list[str]:
    """Every numeric column that is no key, text or label."""
    return [
        f.name for f in panel.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES
    ]


def exact_medians(
    df: DataFrame, columns: Sequence[str], group: Sequence[str] = (), bounds: Bounds | None = None
) -> DataFrame:
    """(group, column_name, median) of the known values (NaN is none); a column with none has no row.

    Equal values are counted before the shuffle and the ranks come from sliced running sums,
    so neither a frequent value nor a large group has to fit into one task. All columns are
    ranked in one pass.
    """
    long = df.select(
        *group,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), known(F.col(c)).alias("value"))
                      for c in columns])
        ).alias("_cell"),
    ).select(*group, "_cell.column_name", "_cell.value")
    keys = [*group, "column_name"]
    values = long.dropna(subset=[*keys, "value"])
    if bounds is None:
        bounds = slice_bounds(values, [*keys, "value"])
    counts = values.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    ranked = sum_before(counts, keys, ["value"], ["n"], bounds=bounds)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")

    def at(rank):
        return F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col("value")))

    return ranked.join(totals, keys).groupBy(*keys).agg(
        ((at(low) + at(high)) / F.lit(2.0)).alias("median")
    )


@dataclass(frozen=True)
class NumericPrep:
    """Fitted medians, means and standard deviations, by column."""

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return list(self.medians)

    def transform(self, df: DataFrame, prefix: str = "std_") -> DataFrame:
        """Adds each column imputed and scaled, as one projection."""
        return df.withColumns(
            {
                f"{prefix}{c}": (
                    F.coalesce(known(F.col(c)), F.lit(self.medians[c])) - F.lit(self.means[c])
                ) / F.lit(self.deviations[c])
                for c in self.columns
            }
        )


def fit_numeric(train: DataFrame, columns: Sequence[str], n_train: int | None = None) -> NumericPrep:
    """Medians, then mean and population deviation after filling; all-null columns drop out.

    Where ``n_train`` says that all values fit into one task the medians are plain
    aggregates, beyond that they are ranked in slices. A constant column keeps deviation 1,
    so that it scales to zeros.
    """
    if n_train is not None and n_train <= SMALL_BLOCK:
        row = train.agg(*[F.median(known(F.col(c))).alias(c) for c in columns]).first()
        found = {c: row[c] for c in columns if row[c] is not None}
    else:
        found = {r["column_name"]: r["median"] for r in exact_medians(train, columns).collect()}
    medians = {c: found[c] for c in columns if c in found}
    if not medians:
        raise ValueError("no numeric column has a value")
    filled = {c: F.coalesce(known(F.col(c)), F.lit(m)) for c, m in medians.items()}
    row = train.agg(
        *[F.avg(v).alias(f"m_{c}") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items()],
    ).first()
    return NumericPrep(
        medians,
        {c: row[f"m_{c}"] for c in medians},
        {c: row[f"s_{c}"] or 1.0 for c in medians},
    )
