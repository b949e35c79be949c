"""Range filters, completeness and reshaping."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from gridcast.functions.scalars import minute_text, percent_text, round_half_even
from gridcast.operators import columns, ranges
from gridcast.operators.ordered import with_windows
from gridcast.operators.windows import persistence
from queries.inputs import EVENTS, FORECASTS, HOURLY, KEYS, events, forecasts, hourly, table
from queries.registry import query, r6

ORDERS = f"SELECT o_orderkey, o_orderdate, {r6('o_totalprice')} AS o_totalprice FROM orders WHERE "


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("range_halfopen", ORDERS + "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-07-01'")
def range_halfopen(spark, sf_dir):
    return ranges.half_open(orders(spark, sf_dir), "o_orderdate", datetime(1996, 1, 1), datetime(1999, 7, 1))


@query(
    "range_closed",
    ORDERS + "o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-06-30 23:59:00'",
)
def range_closed(spark, sf_dir):
    end = datetime(1999, 6, 30, 23, 59)
    return ranges.closed(orders(spark, sf_dir), "o_orderdate", datetime(1996, 1, 1), end)


@query("trim_upper", ORDERS + "o_orderdate <= TIMESTAMP '2000-02-29 23:59:59'")
def trim_upper(spark, sf_dir):
    return ranges.until_end_of_day(orders(spark, sf_dir), "o_orderdate", date(2000, 2, 29))


@query(
    "relative_window",
    f"""WITH {EVENTS}, chosen AS (
          SELECT 'around' AS preset, * FROM events_ WHERE datetime::DATE BETWEEN DATE '2024-01-12' AND DATE '2024-01-17'
          UNION ALL SELECT '24h', * FROM events_ WHERE datetime::DATE BETWEEN DATE '2024-01-14' AND DATE '2024-01-15'
          UNION ALL SELECT '7d', * FROM events_ WHERE datetime::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-15'
          UNION ALL SELECT '30d', * FROM events_ WHERE datetime::DATE BETWEEN DATE '2023-12-16' AND DATE '2024-01-15'
          UNION ALL SELECT 'all', * FROM events_)
        SELECT preset, CAST(count(*) AS BIGINT) AS n, min(datetime) AS first, max(datetime) AS last, {r6('sum(value)')} AS total
        FROM chosen GROUP BY 1""",
)
def relative_window(spark, sf_dir):
    as_of = date(2024, 1, 15)
    spans = {preset: ranges.preset_days(preset, as_of) for preset in ("24h", "7d", "30d")}
    spans |= {"around": ranges.days_around(as_of), "all": None}
    return (
        ranges.in_ranges(events(spark, sf_dir), "datetime", spans)
        .groupBy("preset")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("datetime").alias("first"),
            F.max("datetime").alias("last"),
            F.sum("value").alias("total"),
        )
    )


@query(
    "trailing_window",
    f"""WITH {EVENTS}, latest AS (SELECT max(datetime) AS last_at FROM events_ WHERE event_type <> 'error' AND datetime < TIMESTAMP '2024-01-20')
        SELECT event_id, datetime, CASE WHEN event_type <> 'error' AND datetime < TIMESTAMP '2024-01-20' THEN {r6('value')} END AS reading
        FROM events_, latest WHERE datetime BETWEEN last_at - INTERVAL 1 DAY AND last_at""",
)
def trailing_window(spark, sf_dir):
    known = (F.col("event_type") != "error") & (F.col("datetime") < F.lit("2024-01-20").cast("timestamp"))
    df = events(spark, sf_dir).select("event_id", "datetime", F.when(known, F.col("value")).alias("reading"))
    return ranges.trailing(df, "datetime", "reading", timedelta(days=1))


@query(
    "time_bounds",
    """SELECT event_type, min(ts) AS first, max(ts) AS last, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""",
)
def time_bounds(spark, sf_dir):
    return (
        events(spark, sf_dir)
        .groupBy("event_type")
        .agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "complete_rows",
    f"""WITH {HOURLY}, lagged AS (SELECT *, lag(speed, 48) OVER (PARTITION BY event_type ORDER BY datetime) AS baseline FROM hourly)
        SELECT event_type, datetime, {r6('speed')} AS speed, {r6('baseline')} AS baseline FROM lagged WHERE baseline IS NOT NULL""",
)
def complete_rows(spark, sf_dir):
    lagged = with_windows(
        hourly(spark, sf_dir),
        KEYS,
        ["datetime"],
        48,
        lambda df, w: df.withColumn("baseline", persistence(w, "speed")),
        unique=True,
    )
    chosen = lagged.select("event_type", "datetime", "speed", "baseline")
    return columns.require_rows(columns.complete_rows(chosen, ["speed", "baseline"]))


@query(
    "hour_modulo_topk",
    f"""WITH {HOURLY} SELECT event_type, strftime(datetime, '%Y-%m-%d %H:%M') AS timestamp,
          printf('%.1f', round_even(speed * 10, 0) / 10) || '%' AS actual
        FROM hourly WHERE hour(datetime) % 6 = 0 ORDER BY datetime DESC, event_type DESC LIMIT 8""",
)
def hour_modulo_topk(spark, sf_dir):
    full_steps = ranges.every_hours(hourly(spark, sf_dir), "datetime", 6)
    return columns.newest(full_steps, ["datetime", "event_type"], 8).select(
        "event_type",
        minute_text(F.col("datetime")).alias("timestamp"),
        percent_text(round_half_even(F.col("speed"))).alias("actual"),
    )


@query(
    "unpivot_series",
    f"""WITH {FORECASTS}
        SELECT event_type, datetime, 'speed' AS variable, {r6('speed')} AS value FROM forecasts
        UNION ALL SELECT event_type, datetime, 'prediction', {r6('prediction')} FROM forecasts
        UNION ALL SELECT event_type, datetime, 'baseline', {r6('baseline')} FROM forecasts""",
)
def unpivot_series(spark, sf_dir):
    return columns.unpivot_series(
        forecasts(spark, sf_dir), ["event_type", "datetime"], ["speed", "prediction", "baseline"]
    )


@query(
    "preview_rows",
    f"""WITH {EVENTS}
        (SELECT 'head' AS part, event_id, datetime, {r6('value')} AS value FROM events_ ORDER BY datetime, event_id LIMIT 5)
        UNION ALL
        (SELECT 'tail', event_id, datetime, {r6('value')} FROM events_ ORDER BY datetime DESC, event_id DESC LIMIT 5)""",
)
def preview_rows(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "datetime", "value")
    order = ["datetime", "event_id"]
    head = columns.preview(df, order).withColumn("part", F.lit("head"))
    return head.unionByName(columns.preview(df, order, last=True).withColumn("part", F.lit("tail")))
