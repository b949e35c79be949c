from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import pytest
from plans import plan
from pyspark.sql import functions as F

from gridcast.functions import metrics, scalars
from gridcast.operators import columns, folds, ranges
from gridcast.plans import analysis

T0 = datetime(2024, 1, 10)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "y DOUBLE, p DOUBLE")


def measure(df, *aggregates):
    return tuple(df.agg(*aggregates).first())


def test_rmse_and_mape_skip_incomplete_pairs(spark):
    y, p = F.col("y"), F.col("p")
    df = pairs(spark, (10.0, 12.0), (20.0, 16.0), (None, 5.0), (5.0, None))
    rmse, mape = measure(df, metrics.rmse(y, p), metrics.mape(y, p))
    assert rmse == pytest.approx(math.sqrt(10)) and mape == pytest.approx(0.2)


def test_zero_actual_blows_mape_up_unless_excluded(spark):
    y, p = F.col("y"), F.col("p")
    df = pairs(spark, (0.0, 1.0), (10.0, 11.0))
    full, without = measure(df, metrics.mape(y, p), metrics.mape(y, p, zero="exclude"))
    assert full == pytest.approx((1 / 2.220446049250313e-16 + 0.1) / 2) and without == pytest.approx(0.1)
    with pytest.raises(ValueError):
        metrics.mape(y, p, zero="skip")


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 2.0), (None, 1.0)]])
def test_metrics_need_two_pairs(spark, rows):
    y, p = F.col("y"), F.col("p")
    df = pairs(spark, *rows)
    assert measure(df, metrics.guarded(metrics.rmse(y, p), y, p)) == (None,)


@pytest.mark.parametrize(
    ("value", "base", "expected"),
    [
        (1.0, 2.0, ("success", "danger", "↓", -0.5)),
        (2.0, 1.0, ("danger", "success", "↑", 1.0)),
        (2.0, 2.0, ("warning", "warning", "=", 0.0)),
        (None, 2.0, ("secondary", "secondary", "", None)),
        (2.0, None, ("secondary", "secondary", "", None)),
        (1.0, 0.0, ("danger", "success", "↑", None)),
    ],
)
def test_status(spark, value, base, expected):
    y, p = F.col("y"), F.col("p")
    row = pairs(spark, (value, base)).select(
        metrics.status(y, p), metrics.status(y, p, lower_better=False), metrics.arrow(y, p), metrics.relative_change(y, p)
    )
    assert tuple(row.first()) == expected


def test_clip_cube_and_rounding(spark):
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in (None, -1.0, 0.0, 15.0, 20.0)], "x DOUBLE")
    power = scalars.power_curve(x)
    rows = df.select(power["wind_speed_v3"].alias("a"), power["wind_speed_v3_clip"].alias("b")).collect()
    assert [tuple(r) for r in rows] == [(None, None), (-1.0, 0.0), (0.0, 0.0), (3375.0, 3375.0), (8000.0, 3375.0)]
    halves = spark.createDataFrame([(0.25,), (0.35,), (-0.25,), (2.0,)], "x DOUBLE")
    assert [r[0] for r in halves.select(scalars.round_half_even(x)).collect()] == [0.2, 0.4, -0.2, 2.0]


def test_texts(spark):
    x = F.col("x")
    df = spark.createDataFrame([(0.125,), (12.0,), (None,)], "x DOUBLE")
    rows = df.select(scalars.number_text(x), scalars.percent_text(x), scalars.change_text(x), scalars.change_text(-x, 1))
    assert [tuple(r) for r in rows.collect()] == [
        ("0.12", "0.1%", "+12%", "-12.5%"),
        ("12.00", "12.0%", "+1200%", "-1200.0%"),
        ("N/A", None, "N/A", "N/A"),
    ]


def table(spark, values, predictions=None):
    predictions = predictions or [None] * len(values)
    rows = [(T0 + timedelta(hours=i), v, None, p) for i, (v, p) in enumerate(zip(values, predictions))]
    return spark.createDataFrame(
        rows, "datetime TIMESTAMP, wind_perc DOUBLE, wind_perc_lag_48h DOUBLE, wind_perc_pred DOUBLE"
    )


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([], None),
        ([1.0], None),
        ([1.0, 3.0], ("↑", 2.0)),
        ([3.0, 100.0, 1.0], ("↓", 2.0)),
        ([2.0, 2.0], ("↓", 0.0)),
        ([99.0] + [1.0] * 6 + [2.0] * 6, ("↑", 1.0)),
        ([1.0, None, 3.0, None], ("↑", 2.0)),
    ],
)
def test_trend(spark, values, expected):
    row = analysis.trend(table(spark, values)).first()
    assert (row and (row.direction, row.gap)) == expected
    keyed = table(spark, values).withColumn("site", F.lit("s"))
    rows = analysis.trend(keyed, ["site"]).collect()
    assert [(r.direction, r.gap) for r in rows] == ([expected] if expected else [])


def test_trend_limits_each_series_before_the_shuffle(spark):
    keyed = table(spark, [1.0, 2.0]).withColumn("site", F.date_format("datetime", "HH"))
    text = plan(analysis.trend(keyed, ["site"]))
    assert "WindowGroupLimit" in text.split("Exchange")[-1]


def test_analysis_table(spark):
    history = table(spark, [1.0, 2.0]).drop("wind_perc_pred")
    full = table(spark, [0.0] * 2, [10.0, 20.0]).select("datetime", "wind_perc_pred")
    latest = table(spark, [0.0] * 3, [11.0, 21.0, 31.0]).select("datetime", "wind_perc_pred").where("wind_perc_pred > 20")
    df = analysis.analysis_table(history, full, latest)
    assert df.columns == ["datetime", "wind_perc", "wind_perc_lag_48h", "wind_perc_pred"]
    rows = [(r.wind_perc, r.wind_perc_pred) for r in df.orderBy("datetime").collect()]
    assert rows == [(1.0, 10.0), (2.0, 21.0), (None, 31.0)]
    only = analysis.analysis_table(history.limit(0), full.limit(0), latest)
    assert [(r.wind_perc, r.wind_perc_pred) for r in only.orderBy("datetime").collect()] == [(None, 21.0), (None, 31.0)]
    day = (date(2024, 1, 10), date(2024, 1, 10))
    assert analysis.analysis_table(history, full, latest, days=day).count() == 3


def test_reports_of_an_empty_table(spark):
    report = analysis.range_report(table(spark, []), date(2024, 1, 1), date(2024, 1, 2))
    kpi = report.kpis.first()
    assert (kpi.model_rmse, kpi.rmse_status, kpi.model_rmse_text, kpi.rmse_change_text) == (None, "secondary", "N/A", "N/A")
    assert report.errors.isEmpty() and report.sample.isEmpty()
    forecast = analysis.forecast_report(table(spark, []), date(2024, 1, 1))
    assert forecast.values.isEmpty() and forecast.trend.isEmpty()


def test_forecast_report_values(spark):
    df = table(spark, [float(i) for i in range(60)], [0.25] * 60)
    rows = analysis.forecast_report(df, date(2024, 1, 11)).values.collect()
    assert len(rows) == 8
    assert tuple(rows[0]) == ("2024-01-12 06:00", "54.0%", "0.2%")


def test_ranges(spark):
    df = spark.range(0, 73).select((F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("datetime"))
    assert ranges.closed_days(df, "datetime", date(2024, 1, 10), date(2024, 1, 11)).count() == 48
    assert ranges.closed(df, "datetime", T0, T0 + timedelta(days=1)).count() == 25
    assert ranges.half_open(df, "datetime", T0, T0 + timedelta(days=1)).count() == 24
    assert ranges.until_end_of_day(df, "datetime", date(2024, 1, 10)).count() == 24
    assert ranges.around(df, "datetime", date(2024, 1, 13)).count() == 73
    assert ranges.preset_days("7d", date(2024, 1, 13)) == (date(2024, 1, 6), date(2024, 1, 13))
    with pytest.raises(ValueError):
        ranges.preset_days("all", date(2024, 1, 13))
    markers = [r.marker.day for r in ranges.day_markers(df, "datetime").orderBy("marker").collect()]
    assert markers == [10, 11, 12, 13]
    assert ranges.day_markers(df.limit(0), "datetime").isEmpty()
    assert ranges.bounds(df.limit(0), "datetime") == (None, None)


def test_trailing_ends_at_the_latest_observation(spark):
    df = table(spark, [1.0] * 30 + [None] * 10)
    assert ranges.trailing(df, "datetime", "wind_perc").count() == 25
    assert ranges.trailing(df, "datetime", "wind_perc_pred").isEmpty()


def test_columns(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "x")], "a INT, b DOUBLE, c STRING")
    assert [r.b for r in columns.nan_to_null(df).orderBy("a").collect()] == [None, 1.0]
    assert columns.complete_rows(df, ["b"]).count() == 1
    assert columns.matching(df, "^[ab]$") == ["a", "b"] and columns.matching(df, "a", keep=False) == ["b", "c"]
    profile = {r.column_name: r.nulls for r in columns.null_profile(columns.nan_to_null(df)).collect()}
    assert profile == {"a": 0, "b": 1, "c": 1}
    assert columns.ensure_columns(df, {"a": "int", "d": "double"}).columns == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="no rows"):
        columns.require_rows(df.limit(0))


@pytest.mark.parametrize(("total", "k", "t", "gap"), [(10, 3, 3, 0), (31, 3, 10, 0), (100, 5, 15, 7), (6, 5, 1, 0)])
def test_folds_are_disjoint_and_of_exact_size(total, k, t, gap):
    found = folds.walk_forward_folds(total, k, t, gap)
    tested = [range(f.test_start, f.test_end) for f in found]
    assert [len(r) for r in tested] == [t] * k
    assert [i for r in tested for i in r] == list(range(total - k * t, total))
    assert all(0 < f.train_end == f.test_start - gap for f in found)


@pytest.mark.parametrize(("total", "k", "t", "gap"), [(9, 3, 3, 0), (10, 3, 3, 1), (0, 5, 48, 0), (10, 2, 0, 0)])
def test_folds_without_training_rows_are_refused(total, k, t, gap):
    with pytest.raises(ValueError):
        folds.walk_forward_folds(total, k, t, gap)


def test_walk_forward_and_holdout_rows(spark):
    df = spark.range(100).select((F.lit(T0) + F.make_dt_interval(hours=(F.col("id") % 50).cast("int"))).alias("t"), "id")
    rows = folds.walk_forward(df, ["t", "id"], n_splits=2, test_size=10, gap=5).collect()
    sizes = {}
    for r in rows:
        sizes[(r.fold, r.role)] = sizes.get((r.fold, r.role), 0) + 1
    assert sizes == {(1, "train"): 75, (1, "test"): 10, (2, "train"): 85, (2, "test"): 10}
    split = folds.holdout_split(df, ["t", "id"], 7)
    held = {r.id for r in split.where("role = 'holdout'").collect()}
    assert held == {49, 99, 48, 98, 47, 97, 96}
    assert "Exchange" not in plan(split)
    assert folds.holdout_split(df, ["t", "id"], 1000).where("role = 'train'").isEmpty()


@pytest.mark.parametrize("rows", [0, 1, 7, 8, 9, 100])
def test_stride_sample(spark, rows):
    got = [r.id for r in folds.stride_sample(spark.range(rows), ["id"]).orderBy("id").collect()]
    assert got == list(range(rows))[:: max(1, rows // 8)][:8]
