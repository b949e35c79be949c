"""Request tiles of a date range, and which of them a store still lacks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def range_of(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row `start, end`, the input of the tilings below."""
    return spark.createDataFrame([(start, end)], "start DATE, end DATE")


def day_tiles(ranges: DataFrame, days: int = 30) -> DataFrame:
    """Cut `start … end` (both included) into tiles of `days` days, the last one shorter."""
    starts = F.explode(F.sequence("start", "end", F.expr(f"INTERVAL {days} DAY")))
    return _tiles(ranges, starts, F.date_add("first_day", days - 1))


def month_tiles(ranges: DataFrame) -> DataFrame:
    """Whole calendar months the range touches."""
    firsts = F.sequence(F.trunc("start", "MONTH"), F.trunc("end", "MONTH"), F.expr("INTERVAL 1 MONTH"))
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    months = ranges.where("start <= end").select(*rest, F.explode(firsts).alias("first_day"))
    return months.withColumn("last_day", F.last_day("first_day"))


def year_tiles(ranges: DataFrame) -> DataFrame:
    """Cut the range at the ends of calendar years."""
    firsts = F.sequence(F.trunc("start", "YEAR"), F.trunc("end", "YEAR"), F.expr("INTERVAL 1 YEAR"))
    starts = F.explode(F.transform(firsts, lambda day: F.greatest(day, F.col("start"))))
    return _tiles(ranges, starts, F.make_date(F.year("first_day"), F.lit(12), F.lit(31)))


def _tiles(ranges: DataFrame, starts, last) -> DataFrame:
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    tiles = ranges.where("start <= end").select(*rest, "end", starts.alias("first_day"))
    return tiles.withColumn("last_day", F.least(last, F.col("end"))).drop("end")


def missing_months(ranges: DataFrame, stored: DataFrame, month: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """Month tiles without any stored row; `stored[month]` is the first day of a stored month."""
    have = stored.select(*keys, F.col(month).alias("first_day"))
    return month_tiles(ranges).join(have, [*keys, "first_day"], "left_anti")
