"""Weeks of the panel, expanding-window folds and the final holdout.

The tables here have one row per calendar week (or week and fold), whatever the data size.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPARE_WEEKS = 10


def week_index(panel: DataFrame) -> DataFrame:
    """(week_start, week_no): the distinct weeks of all assets, numbered from 1."""
    weeks = panel.where(F.col("week_start").isNotNull()).select("week_start").distinct()
    return weeks.select("week_start", F.row_number().over(Window.orderBy("week_start")).alias("week_no"))


def expanding_folds(
    weeks: DataFrame, train_min_weeks: int = 78, val_weeks: int = 12, step_weeks: int = 4
) -> DataFrame:
    """(fold_id, week_start, role): fold i trains on all weeks before its validation block.

    No rows where the weeks do not reach for one fold.
    """
    numbered = week_index(weeks).withColumn("_all", F.count("*").over(Window.partitionBy()))
    last = F.floor(
        (F.col("_all") - F.lit(train_min_weeks + val_weeks)) / F.lit(step_weeks)
    ).cast("int")
    fitting = numbered.where(F.col("_all") >= train_min_weeks + val_weeks)
    spread = fitting.select(
        "week_start", "week_no", F.explode(F.sequence(F.lit(0), last)).alias("_fold")
    )
    end = F.lit(train_min_weeks) + F.col("_fold") * F.lit(step_weeks)
    role = F.when(F.col("week_no") <= end, "train").when(F.col("week_no") <= end + val_weeks, "val")
    return spread.select((F.col("_fold") + 1).alias("fold_id"), "week_start", role.alias("role")).where(
        F.col("role").isNotNull()
    )


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The panel rows of every fold. The fold table is calendar-sized; AQE chooses the join."""
    return panel.join(folds, "week_start")


def holdout_roles(panel: DataFrame, test_weeks: int = 26) -> DataFrame:
    """(week_start, role): the last ``test_weeks`` distinct weeks are ``test``, the others ``train_val``."""
    numbered = week_index(panel).withColumn("_all", F.count("*").over(Window.partitionBy()))
    role = F.when(F.col("week_no") > F.col("_all") - test_weeks, "test").otherwise("train_val")
    return numbered.select("week_start", role.alias("role"))


def distinct_weeks(panel: DataFrame) -> list[datetime]:
    """The sorted weeks, on the driver: one value per calendar week."""
    return [r[0] for r in week_index(panel).orderBy("week_no").select("week_start").collect()]


def holdout_start(weeks: list[datetime], test_weeks: int = 26) -> datetime:
    """First test week; refuses a panel too short for a split."""
    if len(weeks) <= test_weeks + SPARE_WEEKS:
        raise ValueError(
            f"{len(weeks)} weeks are too few for {test_weeks} test weeks and {SPARE_WEEKS} to learn from"
        )
    return weeks[-test_weeks]


@dataclass(frozen=True)
class Fold:
    """Weeks before ``val_start`` train, weeks in [val_start, val_end] validate."""

    fold_id: int
    val_start: datetime
    val_end: datetime

    def train(self, panel: DataFrame) -> DataFrame:
        return panel.where(F.col("week_start") < F.lit(self.val_start))

    def validation(self, panel: DataFrame) -> DataFrame:
        return panel.where(F.col("week_start").between(F.lit(self.val_start), F.lit(self.val_end)))


def fold_list(
    weeks: list[datetime], train_min_weeks: int = 78, val_weeks: int = 12, step_weeks: int = 4
) -> list[Fold]:
    """The folds of ``expanding_folds`` as week bounds, for one fit per fold."""
    ends = range(train_min_weeks, len(weeks) - val_weeks + 1, step_weeks)
    return [
        Fold(number, weeks[end], weeks[end + val_weeks - 1]) for number, end in enumerate(ends, start=1)
    ]


def fold_timeline(
    panel: DataFrame,
    train_min_weeks: int = 78,
    val_weeks: int = 12,
    step_weeks: int = 4,
    test_weeks: int = 26,
    zoom_weeks: int = 60,
) -> DataFrame:
    """(block, start_week, end_week, weeks, zoom_start): outer blocks and the last inner fold.

    ``zoom_start`` is the week ``zoom_weeks`` from the end of the last fold's training block.
    """
    roles = holdout_roles(panel, test_weeks)
    inner = expanding_folds(
        roles.where(F.col("role") == "train_val"), train_min_weeks, val_weeks, step_weeks
    )
    final = inner.withColumn("_last", F.max("fold_id").over(Window.partitionBy())).where(
        F.col("fold_id") == F.col("_last")
    )
    blocks = final.select(
        "week_start", F.concat(F.lit("last_fold_"), "role").alias("block")
    ).unionByName(roles.select("week_start", F.col("role").alias("block")))
    recent = F.reverse(F.sort_array(F.collect_list("week_start")))
    zoom = F.when(
        F.col("block") == "last_fold_train",
        F.element_at(recent, F.least(F.lit(zoom_weeks), F.size(recent))),
    )
    return blocks.groupBy("block").agg(
        F.min("week_start").alias("start_week"), F.max("week_start").alias("end_week"),
        F.count("*").alias("weeks"), zoom.alias("zoom_start"),
    )
