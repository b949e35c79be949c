"""Elementwise Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The plain cast reads ISO text with seconds or without a zone, but no zone after minutes.
ISO_MINUTES_ZONE = "yyyy-MM-dd'T'HH:mmXXX"


def cube(x: Column) -> Column:
    return x * x * x


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL: `greatest` alone would turn it into the bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def power_curve(speed: Column, rated: float = 15.0) -> dict[str, Column]:
    """Power grows with the cube of the speed, up to the rated speed of a turbine."""
    return {
        "wind_speed_v3": cube(speed),
        "wind_speed_v3_clip": cube(clip(speed, 0.0, rated)),
    }


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Hour, day of week (Monday = 0), day of year and their positions on the circle."""
    hour, day = F.hour(ts), F.dayofyear(ts)

    def angle(x: Column, period: float) -> Column:
        return F.lit(2.0) * F.pi() * x / F.lit(period)

    return {
        "hour": hour,
        "dayofweek": F.weekday(ts),
        "dayofyear": day,
        "sin_hour": F.sin(angle(hour, 24.0)),
        "cos_hour": F.cos(angle(hour, 24.0)),
        "sin_dayofyear": F.sin(angle(day, 365.25)),
        "cos_dayofyear": F.cos(angle(day, 365.25)),
    }


def parse_utc(text: Column) -> Column:
    """ISO text to a UTC instant: texts with a zone are converted, bare ones taken as UTC.

    NULL for malformed text. The session zone has to be UTC.
    """
    return F.coalesce(F.try_to_timestamp(text, F.lit(ISO_MINUTES_ZONE)), F.try_to_timestamp(text))


def round_half_even(x: Column, places: int = 1) -> Column:
    """Scale, round to the nearest integer with ties to even, scale back."""
    scale = float(10**places)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def percent_text(x: Column, places: int = 1) -> Column:
    """`12.3%`, NULL for NULL."""
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f%%", x))


def number_text(x: Column, places: int = 2) -> Column:
    """Fixed places, `N/A` for NULL."""
    rounded = round_half_even(x, places)
    return F.coalesce(F.when(x.isNotNull(), F.format_string(f"%.{places}f", rounded)), F.lit("N/A"))


def change_text(share: Column, places: int = 0) -> Column:
    """A share as a signed percentage such as `+12%`, `N/A` for NULL."""
    rounded = round_half_even(share * F.lit(100.0), places)
    return F.coalesce(F.when(share.isNotNull(), F.format_string(f"%+.{places}f%%", rounded)), F.lit("N/A"))


def signed_error(prediction: Column, actual: Column) -> Column:
    return prediction - actual
