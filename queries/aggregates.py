"""Profiles, metrics and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.metrics import guarded, mape, relative_gain, rmse, skill_columns, with_skill
from gridcast.operators.columns import null_profile
from gridcast.operators.dedupe import keep_first, keep_last
from gridcast.operators.folds import walk_forward
from gridcast.plans.analysis import trend
from gridcast.plans.training import fold_summary
from queries.inputs import EVENTS, FORECASTS, HOURLY, KEYS, events, forecasts, hourly
from queries.registry import query, r6

RMSE = "sqrt(avg(({p} - speed) * ({p} - speed)))"
MAPE = "avg(abs({p} - speed) / greatest(abs(speed), 2.220446049250313e-16))"
GUARDED = "CASE WHEN count({p} - speed) > 1 THEN {metric} END"


def metric_sql(metric: str, column: str) -> str:
    """SQL of a guarded metric; pairs without a forecast drop out of `avg`."""
    return GUARDED.format(p=column, metric=metric.format(p=column))


@query(
    "null_profile",
    f"""WITH {FORECASTS}
        SELECT 'speed' AS column_name, CAST(count(*) - count(speed) AS BIGINT) AS nulls FROM forecasts
        UNION ALL SELECT 'prediction', count(*) - count(prediction) FROM forecasts
        UNION ALL SELECT 'baseline', count(*) - count(baseline) FROM forecasts""",
)
def null_profile_of_lags(spark, sf_dir):
    return null_profile(forecasts(spark, sf_dir), ["speed", "prediction", "baseline"])


@query(
    "row_counts",
    f"""WITH {FORECASTS} SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(baseline) AS BIGINT) AS complete
        FROM forecasts GROUP BY 1""",
)
def row_counts(spark, sf_dir):
    return (
        forecasts(spark, sf_dir)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count("baseline").alias("complete"))
    )


@query(
    "rmse_mape",
    f"""WITH {FORECASTS} SELECT event_type, {r6(RMSE.format(p='baseline'))} AS rmse, {r6(MAPE.format(p='baseline'))} AS mape
        FROM forecasts GROUP BY 1""",
)
def rmse_mape(spark, sf_dir):
    actual, baseline = F.col("speed"), F.col("baseline")
    metrics = [rmse(actual, baseline).alias("rmse"), mape(actual, baseline).alias("mape")]
    return forecasts(spark, sf_dir).groupBy("event_type").agg(*metrics)


@query(
    "guarded_kpi",
    f"""WITH {FORECASTS} SELECT event_type, datetime::DATE AS day,
          {r6(metric_sql(RMSE, 'prediction'))} AS model_rmse, {r6(metric_sql(MAPE, 'prediction'))} AS model_mape,
          {r6(metric_sql(RMSE, 'baseline'))} AS baseline_rmse, {r6(metric_sql(MAPE, 'baseline'))} AS baseline_mape
        FROM forecasts GROUP BY 1, 2""",
)
def guarded_kpi(spark, sf_dir):
    groups = ["event_type", F.to_date("datetime").alias("day")]
    return forecasts(spark, sf_dir).groupBy(*groups).agg(*skill_columns("speed", "prediction", "baseline"))


@query(
    "fold_summary",
    f"""WITH {FORECASTS}, known AS (SELECT * FROM forecasts WHERE baseline IS NOT NULL),
          numbered AS (SELECT *, row_number() OVER (ORDER BY datetime, event_type) - 1 AS r, count(*) OVER () AS total FROM known),
          sized AS (SELECT *, CAST(floor(total * 0.15) AS BIGINT) AS t FROM numbered),
          tested AS (SELECT *, (r - (total - 5 * t)) // t + 1 AS fold FROM sized WHERE r >= total - 5 * t),
          folds AS (SELECT fold, {RMSE.format(p='baseline')} AS rmse, {MAPE.format(p='baseline')} AS mape FROM tested GROUP BY 1)
        SELECT {r6('avg(mape)')} AS mean_mape, {r6('stddev_pop(mape)')} AS std_mape,
               {r6('avg(rmse)')} AS mean_rmse, {r6('stddev_pop(rmse)')} AS std_rmse FROM folds""",
)
def fold_metrics(spark, sf_dir):
    known = forecasts(spark, sf_dir).where("baseline IS NOT NULL")
    order = ["datetime", "event_type"]
    tested = walk_forward(known, order, n_splits=5, fraction=0.15, roles=["test"])
    actual, baseline = F.col("speed"), F.col("baseline")
    metrics = tested.groupBy("fold").agg(
        rmse(actual, baseline).alias("rmse"), mape(actual, baseline).alias("mape")
    )
    return fold_summary(metrics)


@query(
    "half_window_trend",
    f"""WITH {HOURLY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY datetime DESC) AS back FROM hourly),
          recent AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS c FROM ranked WHERE back <= 11),
          halves AS (SELECT event_type, avg(CASE WHEN back > c - c // 2 THEN speed END) AS earlier,
                            avg(CASE WHEN back <= c // 2 THEN speed END) AS later FROM recent WHERE c >= 2 GROUP BY 1)
        SELECT event_type, {r6('earlier')} AS earlier_mean, {r6('later')} AS later_mean,
          CASE WHEN later > earlier THEN '↑' ELSE '↓' END AS direction,
          CASE WHEN later > earlier THEN 'success' ELSE 'danger' END AS trend_status,
          {r6('round_even(abs(later - earlier) * 10, 0) / 10')} AS gap FROM halves""",
)
def half_window_trend(spark, sf_dir):
    return trend(hourly(spark, sf_dir), KEYS, value="speed", last=11)


@query(
    "skill_status",
    f"""WITH {FORECASTS}, kpi AS (SELECT event_type, datetime::DATE AS day,
            {metric_sql(RMSE, 'prediction')} AS m, {metric_sql(RMSE, 'baseline')} AS b FROM forecasts GROUP BY 1, 2)
        SELECT event_type, day, {r6('m')} AS model_rmse, {r6('b')} AS baseline_rmse,
          CASE WHEN m IS NULL OR b IS NULL THEN 'secondary' WHEN m < b THEN 'success' WHEN m > b THEN 'danger' ELSE 'warning' END AS rmse_status,
          CASE WHEN m IS NULL OR b IS NULL THEN '' WHEN m < b THEN '↓' WHEN m > b THEN '↑' ELSE '=' END AS rmse_arrow,
          {r6('(m - b) / b')} AS rmse_change, {r6('(b - m) / b')} AS rmse_gain FROM kpi""",
)
def skill_status(spark, sf_dir):
    y = F.col("speed")
    kpis = (
        forecasts(spark, sf_dir)
        .groupBy("event_type", F.to_date("datetime").alias("day"))
        .agg(
            *(
                guarded(rmse(y, F.col(c)), y, F.col(c)).alias(f"{who}_rmse")
                for who, c in (("model", "prediction"), ("baseline", "baseline"))
            )
        )
    )
    gain = relative_gain(F.col("model_rmse"), F.col("baseline_rmse"))
    return with_skill(kpis, ["rmse"]).withColumn("rmse_gain", gain)


DEDUPE = f"""WITH {EVENTS}, ranked AS (SELECT *, row_number() OVER (
      PARTITION BY user_id, date_trunc('hour', datetime) ORDER BY datetime {{0}}, event_id {{0}}) AS k FROM events_)
    SELECT user_id, date_trunc('hour', datetime) AS hour_start, event_id, datetime, {r6('value')} AS value, event_type
    FROM ranked WHERE k = 1"""


def user_hours(spark, sf_dir):
    hour = F.date_trunc("HOUR", F.col("datetime")).alias("hour_start")
    return events(spark, sf_dir).select("user_id", hour, "event_id", "datetime", "value", "event_type")


@query("dedupe_first", DEDUPE.format("ASC"))
def dedupe_first(spark, sf_dir):
    return keep_first(user_hours(spark, sf_dir), ["user_id", "hour_start"], ["datetime", "event_id"])


@query("dedupe_last", DEDUPE.format("DESC"))
def dedupe_last(spark, sf_dir):
    return keep_last(user_hours(spark, sf_dir), ["user_id", "hour_start"], ["datetime", "event_id"])
