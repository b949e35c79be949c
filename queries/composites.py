"""Whole dataflows: features, history, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gridcast.functions.metrics import mape, rmse
from gridcast.operators.ranges import days_around
from gridcast.plans import analysis, history, nightly
from gridcast.plans.features import engineer_features
from gridcast.plans.intake import GENERATION, PAST_WEATHER, series, take_in
from gridcast.schemas import HOLDOUT_METRICS, LAG_ROWS, ROLLING_ROWS
from gridcast.session import scratch_path
from gridcast.sources.metrics import read_document, write_document
from gridcast.sources.store import Store
from gridcast.sources.tables import snapshot_once, write_table
from queries.inputs import EVENTS, FORECASTS, HOURLY, IS_HOLIDAY, KEYS, SPEC, events, feature_inputs, forecasts, hourly, table
from queries.registry import query, r6
from queries.scalars import CALENDAR_SQL


def aligned_sql(prefix: str, where: str, weather_where: str | None = None) -> str:
    """CTEs up to `{prefix}aligned`: hourly weather with the nearest generation value."""
    p = prefix
    weather_where = where if weather_where is None else weather_where
    return f"""{p}gen AS (SELECT event_type, ts AS at, value + 0.0 AS wind_perc FROM events {where}),
    {p}met AS (SELECT event_type, date_trunc('hour', ts) AS datetime, CAST(count(*) AS DOUBLE) AS temperature_2m,
        avg(value + 0.0) AS wind_speed_10m FROM events {weather_where} GROUP BY 1, 2),
    {p}before AS (SELECT m.*, g.at AS b_at, g.wind_perc AS b_perc FROM {p}met m ASOF LEFT JOIN {p}gen g
        ON m.event_type = g.event_type AND m.datetime >= g.at),
    {p}near AS (SELECT b.*, g.wind_perc AS a_perc, epoch_us(b.datetime) - epoch_us(b_at) AS behind,
        epoch_us(g.at) - epoch_us(b.datetime) AS ahead FROM {p}before b ASOF LEFT JOIN {p}gen g
        ON b.event_type = g.event_type AND b.datetime <= g.at),
    {p}aligned AS (SELECT event_type, datetime, temperature_2m, wind_speed_10m, CASE
        WHEN behind <= 1800000000 AND (ahead IS NULL OR ahead > 1800000000 OR behind <= ahead) THEN b_perc
        WHEN ahead <= 1800000000 THEN a_perc END AS wind_perc FROM {p}near)"""


def features_sql(prefix: str) -> str:
    """CTE `{prefix}features` on top of `aligned_sql`."""
    columns = []
    for label, n in LAG_ROWS.items():
        columns += [f"lag(wind_perc, {n}) OVER w AS wind_perc_lag_{label}"]
        columns += [f"lag(wind_speed_10m, {n}) OVER w AS wind_speed_lag_{label}"]
    for label, n in ROLLING_ROWS.items():
        over = f"OVER (PARTITION BY event_type ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        columns += [f"avg(wind_speed_10m) {over} AS wind_speed_roll_mean_{label}"]
        columns += [f"stddev_samp(wind_speed_10m) {over} AS wind_speed_roll_std_{label}"]
    return f"""{prefix}shifted AS (SELECT *, power(wind_speed_10m, 3) AS wind_speed_v3,
          power(least(greatest(wind_speed_10m, 0), 15), 3) AS wind_speed_v3_clip, {', '.join(columns)}
        FROM {prefix}aligned WINDOW w AS (PARTITION BY event_type ORDER BY datetime)),
    {prefix}features AS (SELECT *, {CALENDAR_SQL}, CASE WHEN {IS_HOLIDAY.format('datetime')} THEN 1 ELSE 0 END AS is_holiday
        FROM {prefix}shifted WHERE wind_speed_lag_48h IS NOT NULL AND wind_speed_roll_std_3h IS NOT NULL)"""


INTEGERS = ("hour", "dayofweek", "dayofyear", "is_holiday")
FEATURE_COLUMNS = ", ".join(
    name if name in INTEGERS else f"{r6(name)} AS {name}" for name in [SPEC.target, *SPEC.inputs]
)
FEATURES = f"WITH {aligned_sql('', '')}, {features_sql('')} SELECT event_type, datetime, {FEATURE_COLUMNS} FROM features"


def features(spark, sf_dir, **options):
    generation, weather, holidays = feature_inputs(spark, sf_dir)
    return engineer_features(generation, weather, holidays, SPEC, generation_order=["event_id"], unique=True, **options)


@query("engineer_features", FEATURES)
def engineer_features_hourly(spark, sf_dir):
    return features(spark, sf_dir)


@query("engineer_features_ordered", FEATURES)
def engineer_features_ordered(spark, sf_dir):
    return features(spark, sf_dir, strategy="ordered", chunk_rows=2000)


RUN_DAY = date(2024, 1, 20)
RUN_GENERATION = "WHERE ts < TIMESTAMP '2024-01-21'"
RUN_WEATHER = "WHERE ts < TIMESTAMP '2024-01-22'"


@query(
    "nightly_history",
    f"""WITH {aligned_sql('run_', RUN_GENERATION, RUN_WEATHER)}, {features_sql('run_')},
             {aligned_sql('', '')}, {features_sql('')},
        kept AS (SELECT * FROM features WHERE datetime < TIMESTAMP '2024-01-18'
                 UNION ALL SELECT * FROM run_features WHERE datetime >= TIMESTAMP '2024-01-17')
        SELECT DISTINCT event_type, datetime, {FEATURE_COLUMNS} FROM kept""",
)
def nightly_history(spark, sf_dir):
    generation, weather, holidays = feature_inputs(spark, sf_dir)
    tables = nightly.Tables.under(scratch_path(spark, "nightly"))
    snapshot_once(features(spark, sf_dir).where("datetime < timestamp'2024-01-18'"), tables.snapshot)
    rows = nightly.run_features(
        RUN_DAY, generation, weather, weather, holidays, SPEC, ["event_id"], days=None
    )
    write_table(rows, tables.features)
    nightly.extend_history(spark, tables, spark.read.parquet(tables.features), SPEC)
    return history.read_history(spark, tables.history)


# --- history ------------------------------------------------------------------------------

SLOT = ["event_type", "datetime"]


def slots(df):
    """One reading per event, keyed by event type and hour."""
    return df.select("event_type", F.date_trunc("HOUR", F.col("datetime")).alias("datetime"), "event_id", "value")


def batches(spark, sf_dir):
    """An older and a newer overlapping batch of readings, the newer one with shifted values."""
    readings = slots(events(spark, sf_dir))
    older = readings.where("datetime < timestamp'2024-01-20'")
    newer = readings.where("datetime >= timestamp'2024-01-10'").withColumn("value", F.col("value") + 100)
    return older, newer


READINGS = f"{EVENTS}, readings AS (SELECT event_type, date_trunc('hour', datetime) AS datetime, event_id, value FROM events_)"
LAST = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type, datetime ORDER BY precedence DESC, event_id DESC) AS k
      FROM stacked) SELECT event_type, datetime, event_id, {r6('value')} AS value FROM ranked WHERE k = 1"""
HISTORY = f"""WITH {READINGS}, stacked AS (
      SELECT *, 0 AS precedence FROM readings WHERE datetime < TIMESTAMP '2024-01-20'
      UNION ALL SELECT event_type, datetime, event_id, value + 100, 1 FROM readings WHERE datetime >= TIMESTAMP '2024-01-10'),
    {LAST}"""


@query("history_upsert", HISTORY)
def history_upsert(spark, sf_dir):
    older, newer = batches(spark, sf_dir)
    return history.upsert(older, newer, SLOT, ["event_id"])


@query(
    "stale_reset",
    f"""WITH {READINGS}, stacked AS (
          SELECT *, 0 AS precedence FROM readings
          UNION ALL SELECT event_type, datetime, event_id, value + 100, 1 FROM readings WHERE datetime >= TIMESTAMP '2024-01-10'),
        {LAST}""",
)
def stale_reset(spark, sf_dir):
    snapshot = slots(events(spark, sf_dir))
    stale, newer = batches(spark, sf_dir)
    base = history.resolve_history(stale, snapshot, newer)
    return history.upsert(base, newer, SLOT, ["event_id"])


@query(
    "weather_union",
    f"""WITH {HOURLY} SELECT event_type, datetime,
          CASE WHEN datetime >= TIMESTAMP '2024-01-20' THEN {r6('speed + 0.5')} ELSE {r6('speed')} END AS wind_speed_10m
        FROM hourly""",
)
def weather_union(spark, sf_dir):
    series = hourly(spark, sf_dir).select("event_type", "datetime", F.col("speed").alias("wind_speed_10m"))
    past = series.where("datetime < timestamp'2024-01-25'")
    ahead = series.where("datetime >= timestamp'2024-01-20'")
    forecast = ahead.withColumn("wind_speed_10m", F.col("wind_speed_10m") + 0.5)
    return history.assemble_weather(past, forecast, SLOT)


# --- reports ------------------------------------------------------------------------------


def analysis_inputs(spark, sf_dir):
    """History until the 25th, older predictions until the 20th, latest ones from the 18th."""
    df = forecasts(spark, sf_dir).select(
        "event_type",
        "datetime",
        F.col("speed").alias("wind_perc"),
        F.col("baseline").alias("wind_perc_lag_48h"),
        F.col("prediction").alias("wind_perc_pred"),
    )
    known = df.where("datetime < timestamp'2024-01-25'").drop("wind_perc_pred")
    predictions = df.select("event_type", "datetime", "wind_perc_pred")
    full = predictions.where("datetime < timestamp'2024-01-20'")
    latest = predictions.where("datetime >= timestamp'2024-01-18'")
    return known, full, latest.withColumn("wind_perc_pred", F.col("wind_perc_pred") + 0.25)


def analysis_rows(spark, sf_dir, days=None):
    return analysis.analysis_table(*analysis_inputs(spark, sf_dir), on=SLOT, days=days)


ANALYSIS = f"""{FORECASTS}, analysis AS (SELECT event_type, datetime,
      CASE WHEN datetime < TIMESTAMP '2024-01-25' THEN speed END AS wind_perc,
      CASE WHEN datetime < TIMESTAMP '2024-01-25' THEN baseline END AS wind_perc_lag_48h,
      CASE WHEN datetime >= TIMESTAMP '2024-01-18' THEN prediction + 0.25 ELSE prediction END AS wind_perc_pred
    FROM forecasts)"""


@query(
    "analysis_table",
    f"""WITH {ANALYSIS} SELECT event_type, datetime, {r6('wind_perc')} AS wind_perc,
          {r6('wind_perc_lag_48h')} AS wind_perc_lag_48h, {r6('wind_perc_pred')} AS wind_perc_pred FROM analysis""",
)
def analysis_table(spark, sf_dir):
    return analysis_rows(spark, sf_dir)


FIRST_DAY, LAST_DAY, AS_OF = date(2024, 1, 8), date(2024, 1, 24), date(2024, 1, 23)
RANGE = (FIRST_DAY, LAST_DAY)


def kpi_sql(metric: str, column: str) -> str:
    return f"CASE WHEN count({column} - wind_perc) > 1 THEN {metric.format(p=column)} END"


_RMSE = "sqrt(avg(({p} - wind_perc) * ({p} - wind_perc)))"
_MAPE = "avg(abs({p} - wind_perc) / greatest(abs(wind_perc), 2.220446049250313e-16))"


def _status(name: str) -> str:
    m, b = f"model_{name}", f"baseline_{name}"
    places, scale = ("0", "1") if name == "rmse" else ("1", "10")
    missing = f"{m} IS NULL OR {b} IS NULL"
    return f"""
      CASE WHEN {missing} THEN 'secondary' WHEN {m} < {b} THEN 'success' WHEN {m} > {b} THEN 'danger' ELSE 'warning' END AS {name}_status,
      CASE WHEN {missing} THEN '' WHEN {m} < {b} THEN '↓' WHEN {m} > {b} THEN '↑' ELSE '=' END AS {name}_arrow,
      {r6(f'({m} - {b}) / {b}')} AS {name}_change,
      coalesce(printf('%+.{places}f', round_even(({m} - {b}) / {b} * 100 * {scale}, 0) / {scale}) || '%', 'N/A') AS {name}_change_text"""


@query(
    "range_report",
    f"""WITH {ANALYSIS}, kpi AS (SELECT event_type,
          {kpi_sql(_RMSE, 'wind_perc_pred')} AS model_rmse, {kpi_sql(_MAPE, 'wind_perc_pred')} AS model_mape,
          {kpi_sql(_RMSE, 'wind_perc_lag_48h')} AS baseline_rmse, {kpi_sql(_MAPE, 'wind_perc_lag_48h')} AS baseline_mape
          FROM analysis WHERE datetime::DATE BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' GROUP BY 1)
        SELECT event_type, {r6('model_rmse')} AS model_rmse, {r6('model_mape')} AS model_mape,
          {r6('baseline_rmse')} AS baseline_rmse, {r6('baseline_mape')} AS baseline_mape,
          coalesce(printf('%.2f', round_even(model_rmse * 100, 0) / 100), 'N/A') AS model_rmse_text,
          coalesce(printf('%.2f', round_even(baseline_rmse * 100, 0) / 100), 'N/A') AS baseline_rmse_text,
          coalesce(printf('%.1f', round_even(model_mape * 100 * 10, 0) / 10), 'N/A') AS model_mape_text,
          coalesce(printf('%.1f', round_even(baseline_mape * 100 * 10, 0) / 10), 'N/A') AS baseline_mape_text,
          {_status('rmse')}, {_status('mape')} FROM kpi""",
)
def range_report(spark, sf_dir):
    return analysis.range_report(analysis_rows(spark, sf_dir, RANGE), *RANGE, KEYS).kpis


@query(
    "range_report_errors",
    f"""WITH {ANALYSIS} SELECT event_type, datetime, {r6('wind_perc_pred - wind_perc')} AS prediction_error FROM analysis
        WHERE datetime::DATE BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' AND wind_perc_pred - wind_perc IS NOT NULL""",
)
def range_report_errors(spark, sf_dir):
    return analysis.range_report(analysis_rows(spark, sf_dir, RANGE), *RANGE, KEYS).errors


@query(
    "range_report_sample",
    f"""WITH {ANALYSIS}, numbered AS (SELECT *, row_number() OVER (ORDER BY datetime, event_type) - 1 AS r, count(*) OVER () AS n
          FROM analysis WHERE datetime::DATE BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}')
        SELECT event_type, strftime(datetime, '%Y-%m-%d %H:%M') AS timestamp,
          {r6('round_even(wind_perc * 10, 0) / 10')} AS actual, {r6('round_even(wind_perc_pred * 10, 0) / 10')} AS predicted
        FROM numbered WHERE r % greatest(1, n // 8) = 0 AND r < 8 * greatest(1, n // 8)""",
)
def range_report_sample(spark, sf_dir):
    return analysis.range_report(analysis_rows(spark, sf_dir, RANGE), *RANGE, KEYS).sample


RECENT = f"recent AS (SELECT * FROM analysis WHERE datetime::DATE BETWEEN DATE '{AS_OF}' - 3 AND DATE '{AS_OF}' + 2)"


@query(
    "forecast_report",
    f"""WITH {ANALYSIS}, {RECENT} SELECT event_type, strftime(datetime, '%Y-%m-%d %H:%M') AS timestamp,
          printf('%.1f', round_even(wind_perc * 10, 0) / 10) || '%' AS actual,
          printf('%.1f', round_even(wind_perc_pred * 10, 0) / 10) || '%' AS predicted
        FROM recent WHERE hour(datetime) % 6 = 0 ORDER BY datetime DESC, event_type DESC LIMIT 8""",
)
def forecast_report(spark, sf_dir):
    return analysis.forecast_report(analysis_rows(spark, sf_dir, days_around(AS_OF)), AS_OF, KEYS).values


@query(
    "forecast_report_errors",
    f"""WITH {ANALYSIS}, {RECENT} SELECT event_type, datetime, {r6('wind_perc_pred - wind_perc')} AS prediction_error
        FROM recent WHERE wind_perc_pred - wind_perc IS NOT NULL""",
)
def forecast_report_errors(spark, sf_dir):
    return analysis.forecast_report(analysis_rows(spark, sf_dir, days_around(AS_OF)), AS_OF, KEYS).errors


@query(
    "forecast_report_trend",
    f"""WITH {ANALYSIS}, {RECENT},
          ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY datetime DESC) AS back FROM recent WHERE wind_perc IS NOT NULL),
          last_ AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS c FROM ranked WHERE back <= 12),
          halves AS (SELECT event_type, avg(CASE WHEN back > c - c // 2 THEN wind_perc END) AS earlier,
                            avg(CASE WHEN back <= c // 2 THEN wind_perc END) AS later FROM last_ WHERE c >= 2 GROUP BY 1)
        SELECT event_type, {r6('earlier')} AS earlier_mean, {r6('later')} AS later_mean,
          CASE WHEN later > earlier THEN '↑' ELSE '↓' END AS direction,
          CASE WHEN later > earlier THEN 'success' ELSE 'danger' END AS trend_status,
          {r6('round_even(abs(later - earlier) * 10, 0) / 10')} AS gap FROM halves""",
)
def forecast_report_trend(spark, sf_dir):
    return analysis.forecast_report(analysis_rows(spark, sf_dir, days_around(AS_OF)), AS_OF, KEYS).trend


@query(
    "recent_baseline",
    f"""WITH {ANALYSIS}, latest AS (SELECT max(datetime) AS last_at FROM analysis WHERE wind_perc IS NOT NULL)
        SELECT {r6(kpi_sql(_RMSE, 'wind_perc_lag_48h'))} AS baseline_rmse, {r6(kpi_sql(_MAPE, 'wind_perc_lag_48h'))} AS baseline_mape
        FROM analysis, latest WHERE datetime BETWEEN last_at - INTERVAL 1 DAY AND last_at""",
)
def recent_baseline(spark, sf_dir):
    known, _, _ = analysis_inputs(spark, sf_dir)
    return analysis.recent_baseline(known)


_CARDS = f"""model AS (SELECT sqrt(avg((l_extendedprice / 1000 - l_quantity) * (l_extendedprice / 1000 - l_quantity))) AS model_rmse,
      avg(abs(l_extendedprice / 1000 - l_quantity) / greatest(abs(l_quantity), 2.220446049250313e-16)) AS model_mape FROM lineitem),
    base AS (SELECT {kpi_sql(_RMSE, 'wind_perc_lag_48h')} AS baseline_rmse, {kpi_sql(_MAPE, 'wind_perc_lag_48h')} AS baseline_mape
      FROM analysis, latest WHERE datetime BETWEEN last_at - INTERVAL 1 DAY AND last_at),
    cards AS (SELECT * FROM model, base)"""


def _card(name: str) -> str:
    statuses = _status(name).split(f"{name}_arrow,")[0] + f"{name}_arrow"
    return f"{statuses}, {r6(f'(model_{name} - baseline_{name}) / baseline_{name}')} AS {name}_change"


@query(
    "forecast_kpis",
    f"""WITH {ANALYSIS}, latest AS (SELECT max(datetime) AS last_at FROM analysis WHERE wind_perc IS NOT NULL), {_CARDS}
        SELECT {r6('model_rmse')} AS model_rmse, {r6('model_mape')} AS model_mape, {r6('baseline_rmse')} AS baseline_rmse,
          {r6('baseline_mape')} AS baseline_mape, {_card('rmse')}, {_card('mape')} FROM cards""",
)
def forecast_kpis(spark, sf_dir):
    """The cards: holdout metrics from a stored document, here of prices against quantities, beside the recent baseline."""
    known, _, _ = analysis_inputs(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").cast("double").alias("a"))
    found = items.agg(rmse(F.col("a"), F.col("p")).alias("holdout_rmse_perc"), mape(F.col("a"), F.col("p")).alias("holdout_mape_perc"))
    path = scratch_path(spark, "holdout")
    write_document(found, path)
    return analysis.forecast_kpis(read_document(spark, path, HOLDOUT_METRICS, multi_line=False), known)


# --- landed documents ---------------------------------------------------------------------


def landed_generation(spark, sf_dir):
    """A document per event type and day, its readings in the order of their ids."""
    raw = events(spark, sf_dir)
    minute = F.date_format("datetime", "yyyy-MM-dd'T'HH:mm'Z'")
    mix = F.array(F.struct(F.lit("wind").alias("fuel"), F.col("value").alias("perc")))
    reading = F.struct("event_id", F.struct(minute.alias("from"), mix.alias("generationmix")).alias("reading"))
    days = raw.groupBy("event_type", F.to_date("datetime").alias("day")).agg(F.sort_array(F.collect_list(reading)).alias("data"))
    return days.select("event_type", "day", F.to_json(F.struct(F.col("data.reading").alias("data"))).alias("text"))


def landed_weather(spark, sf_dir, shift):
    """A document per event type and day of the hourly means, shifted."""
    hour = F.struct("datetime", (F.col("speed") + shift).alias("speed"), F.col("n").cast("double").alias("n"))
    days = hourly(spark, sf_dir).groupBy("event_type", F.to_date("datetime").alias("day")).agg(F.sort_array(F.collect_list(hour)).alias("h"))
    times = F.transform("h.datetime", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm"))
    arrays = F.struct(times.alias("time"), F.col("h.n").alias("temperature_2m"), F.col("h.speed").alias("wind_speed_10m"))
    return days.select("event_type", "day", F.to_json(F.struct(arrays.alias("hourly"))).alias("text"))


def landings(spark, sf_dir):
    """Two landings of each feed. The second repeats documents, brings changed ones for known times, and broken ones."""
    share, calm = landed_generation(spark, sf_dir), landed_weather(spark, sf_dir, 0.0)
    storm = landed_weather(spark, sf_dir, 0.5)
    early, late = "day < date'2024-01-20'", "day >= date'2024-01-10'"
    changed = share.where("day < date'2024-01-15'").withColumn("text", F.regexp_replace("text", r'"perc":', '"perc": 1'))
    broken = share.where(late).withColumn("text", F.substring("text", 1, 40))
    id_ = F.col("day").cast("string")
    first = [(GENERATION, share.where(early)), (PAST_WEATHER, calm.where(early))]
    second = [(GENERATION, share.where(late).unionByName(changed).unionByName(broken)), (PAST_WEATHER, storm.where(late))]
    return [[(feed, df.withColumn("id", F.concat(F.lit(n), id_))) for feed, df in part] for n, part in ((1, first), (2, second))]


@query(
    "landed_series",
    f"""WITH {EVENTS}, minutes AS (SELECT event_type, date_trunc('minute', datetime) AS datetime, event_id, value FROM events_),
          ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type, datetime ORDER BY event_id) AS k FROM minutes), {HOURLY}
        SELECT 'generation' AS feed, event_type, datetime, {r6('value')} AS value FROM ranked WHERE k = 1
        UNION ALL SELECT 'past_weather', event_type, datetime,
          CASE WHEN datetime >= TIMESTAMP '2024-01-10' THEN {r6('speed + 0.5')} ELSE {r6('speed')} END FROM hourly""",
)
def landed_series(spark, sf_dir):
    store = Store(spark, scratch_path(spark, "store"))
    first, second = landings(spark, sf_dir)
    for number, landing in enumerate([first, second, second]):  # the last one again, as after a lost answer
        for feed, documents in landing:
            take_in(store, feed, documents, f"{feed.name}-{number}", keys=KEYS)
    share = series(store, GENERATION).select("event_type", "datetime", F.col("wind_perc").alias("value"))
    speed = series(store, PAST_WEATHER).select("event_type", "datetime", F.col("wind_speed_10m").alias("value"))
    return share.select(F.lit("generation").alias("feed"), "*").unionByName(speed.select(F.lit("past_weather").alias("feed"), "*"))
