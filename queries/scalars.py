"""Elementwise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.scalars import (
    calendar_columns,
    change_text,
    minute_text,
    number_text,
    percent_text,
    power_curve,
    round_half_even,
    signed_error,
)
from gridcast.operators.ranges import day_markers
from queries.inputs import EVENTS, FORECASTS, HOURLY, events, forecasts, hourly
from queries.registry import query, r6


@query(
    "power_curve",
    f"""WITH {HOURLY}, signed AS (SELECT event_type, datetime, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN -speed
            WHEN 'view' THEN speed / 10 ELSE speed END AS v FROM hourly)
        SELECT event_type, datetime, {r6('v * v * v')} AS wind_speed_v3,
          CASE WHEN v IS NOT NULL THEN {r6('power(least(greatest(v, 0), 15), 3)')} END AS wind_speed_v3_clip FROM signed""",
)
def power_curve_of_speed(spark, sf_dir):
    kind, speed = F.col("event_type"), F.col("speed")
    signed = F.when(kind == "signup", -speed).when(kind == "view", speed / 10).when(kind != "error", speed)
    columns = power_curve(signed)
    return hourly(spark, sf_dir).select("event_type", "datetime", *(c.alias(n) for n, c in columns.items()))


CALENDAR_SQL = f"""CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS dayofweek,
    CAST(dayofyear(datetime) AS INTEGER) AS dayofyear,
    {r6('sin(2 * pi() * hour(datetime) / 24)')} AS sin_hour, {r6('cos(2 * pi() * hour(datetime) / 24)')} AS cos_hour,
    {r6('sin(2 * pi() * dayofyear(datetime) / 365.25)')} AS sin_dayofyear,
    {r6('cos(2 * pi() * dayofyear(datetime) / 365.25)')} AS cos_dayofyear"""


@query("calendar_cycles", f"WITH {EVENTS} SELECT event_id, {CALENDAR_SQL} FROM events_")
def calendar_cycles(spark, sf_dir):
    columns = calendar_columns(F.col("datetime"))
    return events(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in columns.items()))


@query(
    "error_series",
    f"""WITH {FORECASTS} SELECT event_type, datetime, {r6('prediction - speed')} AS prediction_error,
          {r6('abs(prediction - speed)')} AS absolute_error, {r6('sqrt(abs(prediction - speed))')} AS root_error
        FROM forecasts WHERE prediction - speed IS NOT NULL""",
)
def error_series(spark, sf_dir):
    error = signed_error(F.col("prediction"), F.col("speed"))
    return forecasts(spark, sf_dir).where(error.isNotNull()).select(
        "event_type",
        "datetime",
        error.alias("prediction_error"),
        F.abs(error).alias("absolute_error"),
        F.sqrt(F.abs(error)).alias("root_error"),
    )


@query(
    "value_labels",
    f"""WITH {FORECASTS}, shares AS (SELECT *, (prediction - baseline) / nullif(baseline, 0) AS change FROM forecasts)
        SELECT event_type, strftime(datetime, '%Y-%m-%d %H:%M') AS timestamp,
          {r6('round_even(speed * 10, 0) / 10')} AS rounded,
          printf('%.1f', round_even(speed * 10, 0) / 10) || '%' AS actual,
          coalesce(printf('%.2f', round_even(baseline * 100, 0) / 100), 'N/A') AS baseline_text,
          coalesce(printf('%+.1f', round_even(change * 100 * 10, 0) / 10) || '%', 'N/A') AS change_text FROM shares""",
)
def value_labels(spark, sf_dir):
    change = F.try_divide(F.col("prediction") - F.col("baseline"), F.col("baseline"))
    rounded = round_half_even(F.col("speed"))
    return forecasts(spark, sf_dir).select(
        "event_type",
        minute_text(F.col("datetime")).alias("timestamp"),
        rounded.alias("rounded"),
        percent_text(rounded).alias("actual"),
        number_text(F.col("baseline"), 2).alias("baseline_text"),
        change_text(change, 1).alias("change_text"),
    )


@query(
    "day_markers",
    """WITH ends AS (SELECT date_trunc('day', min(ts)) AS first, date_trunc('day', max(ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND) AS last FROM events)
       SELECT unnest(generate_series(first::TIMESTAMP, last::TIMESTAMP, INTERVAL 1 DAY)) AS marker FROM ends""",
)
def markers_of_events(spark, sf_dir):
    return day_markers(events(spark, sf_dir), "datetime")
