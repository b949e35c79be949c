"""Time-range filters, written on the bare column so that they reach the parquet scan."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESETS = {"24h": 1, "7d": 7, "30d": 30}


def half_open(df: DataFrame, ts: str, start, end) -> DataFrame:
    """`start <= ts < end`. With dates: comparing ISO texts up to the bare end date does the same."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def closed(df: DataFrame, ts: str, start, end) -> DataFrame:
    """`start <= ts <= end`."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end)))


def closed_days(df: DataFrame, ts: str, start: date, end: date) -> DataFrame:
    """All rows of the days `start` to `end`, both included."""
    return half_open(df, ts, _midnight(start), _midnight(end + timedelta(days=1)))


def until_end_of_day(df: DataFrame, ts: str, day: date) -> DataFrame:
    """Rows up to 23:59:59 of `day`."""
    return df.where(F.col(ts) <= F.lit(_midnight(day) + timedelta(hours=23, minutes=59, seconds=59)))


def days_around(as_of: date, before: int = 3, after: int = 2) -> tuple[date, date]:
    """First and last day of the stretch from `before` days ahead of `as_of` to `after` past it."""
    return as_of - timedelta(days=before), as_of + timedelta(days=after)


def around(df: DataFrame, ts: str, as_of: date, before: int = 3, after: int = 2) -> DataFrame:
    """The rows of `days_around`."""
    return closed_days(df, ts, *days_around(as_of, before, after))


def preset_days(preset: str, as_of: date, bounds: tuple[date, date] | None = None) -> tuple[date, date]:
    """First and last day of a preset: `24h`, `7d`, `30d`, or `all` for the data's own bounds."""
    if preset == "all":
        if bounds is None:
            raise ValueError("the preset 'all' needs the bounds of the data")
        return bounds
    return as_of - timedelta(days=PRESETS[preset]), as_of


def bounds(df: DataFrame, ts: str) -> tuple[datetime | None, datetime | None]:
    """Earliest and latest timestamp. One row reaches the driver."""
    return tuple(df.agg(F.min(ts), F.max(ts)).first())


def in_ranges(df: DataFrame, ts: str, spans: Mapping[str, tuple[date, date] | None], out: str = "preset") -> DataFrame:
    """Each row once for every span of days (both included) that it lies in, with the span's name as `out`.

    One pass over the rows, however many spans there are and however they overlap; None stands for all
    rows that have a time. Rows outside all spans are left to the scan to skip.
    """
    def within(days: tuple[date, date] | None) -> Column:
        if days is None:
            return F.col(ts).isNotNull()
        return (F.col(ts) >= F.lit(_midnight(days[0]))) & (F.col(ts) < F.lit(_midnight(days[1] + timedelta(days=1))))

    if None not in spans.values() and spans:
        df = closed_days(df, ts, min(s[0] for s in spans.values()), max(s[1] for s in spans.values()))
    names = F.array(*(F.when(within(days), F.lit(name)) for name, days in spans.items())).cast("array<string>")
    return df.withColumn(out, F.explode(F.array_compact(names)))


def years(df: DataFrame, ts: str) -> range:
    """The years from the earliest to the latest time: from the bounds alone, not from the distinct days."""
    first, last = bounds(df, ts)
    return range(first.year, last.year + 1) if first is not None else range(0)


def trailing(df: DataFrame, ts: str, observed: str, span: timedelta = timedelta(days=1)) -> DataFrame:
    """The `span` up to and including the latest row in which `observed` is not NULL.

    The latest timestamp is fetched first: as a literal it prunes the scan, which a value
    joined in at run time would not.
    """
    latest = df.where(F.col(observed).isNotNull()).agg(F.max(ts)).first()[0]
    if latest is None:
        return df.where(F.lit(False))
    return closed(df, ts, latest - span, latest)


def every_hours(df: DataFrame, ts: str, step: int = 6) -> DataFrame:
    """Rows in hours divisible by `step`."""
    return df.where(F.hour(ts) % step == 0)


def day_markers(df: DataFrame, ts: str) -> DataFrame:
    """Every midnight from the start of the first day to the end of the last as `marker`."""
    last = F.max(ts)
    midnight = F.date_trunc("DAY", last)
    end = F.when(midnight == last.cast("timestamp"), midnight).otherwise(midnight + F.expr("INTERVAL 1 DAY"))
    ends = df.agg(F.date_trunc("DAY", F.min(ts)).alias("first"), end.alias("last"))
    return ends.where("first IS NOT NULL").select(
        F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("marker")
    )


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)
