"""Joins and unions of time-series tables on their key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outer_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with one coalesced key; duplicate keys multiply."""
    return left.join(right, list(on), "full")


def override(base: DataFrame, newer: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `base` whose key `newer` does not hold, and all rows of `newer`."""
    return unseen(base, newer, on).unionByName(newer, allowMissingColumns=True)


def unseen(batch: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `batch` with a key that `seen` lacks. Repeats inside the batch stay.

    The keys are made distinct first, so that a key seen very often is combined before the shuffle.
    """
    return batch.join(seen.select(*on).distinct(), list(on), "left_anti")


def append_unseen(seen: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    return seen.unionByName(unseen(batch, seen, on), allowMissingColumns=True)


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns a part lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flag_members(df: DataFrame, day, calendar: DataFrame, out: str = "is_holiday") -> DataFrame:
    """1 where the date expression `day` is in the calendar's `day` column, else 0.

    The calendar carries no broadcast hint: Spark broadcasts it when its size is known to be
    below the session's threshold, and joins by shuffle when it is not.
    """
    days = calendar.select(F.col("day").alias("_day")).where("_day IS NOT NULL").distinct()
    return (
        df.join(days, day == F.col("_day"), "left")
        .withColumn(out, F.col("_day").isNotNull().cast("int"))
        .drop("_day")
    )
