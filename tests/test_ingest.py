from __future__ import annotations

import json
from datetime import date, datetime
from functools import partial

import pytest
from plans import plan
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.scalars import parse_utc
from gridcast.operators.ordered import running_sums
from gridcast.schemas import (
    CV_METRICS,
    GENERATION_DOCUMENT,
    HOLDOUT_METRICS,
    MIX_ENTRY,
    WEATHER_DOCUMENT,
    WEATHER_SERIES,
    FeatureSpec,
    struct,
)
from gridcast.sources import documents, manifest, metrics, tables
from queries import ingest


def landed(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")


def interval(start, *mix):
    return {"from": start, "generationmix": list(mix)}


def generation(*intervals):
    return json.dumps({"data": list(intervals)})


WIND = {"fuel": "wind", "perc": 20.0}


def test_share_takes_the_first_wind_entry_or_null(spark):
    text = generation(
        interval("2024-01-01T00:00Z", {"fuel": "gas", "perc": 50.0}, WIND, {"fuel": "wind", "perc": 99.0}),
        interval("2024-01-01T00:30Z", {"fuel": "gas", "perc": 50.0}),
        interval("2024-01-01T01:00Z", {"fuel": "wind"}),
        interval("2024-01-01T01:30Z"),
        interval(None, WIND),
        interval("", WIND),
        {"from": "2024-01-01T02:00Z"},
    )
    good = documents.check_documents(landed(spark, text), "text", GENERATION_DOCUMENT, "data").good
    rows = documents.share_series(good).orderBy("datetime").collect()
    assert [(r.datetime.hour * 60 + r.datetime.minute, r.wind_perc) for r in rows] == [(0, 20.0), (30, None), (60, None)]


def test_megawatts_prefer_the_measured_output(spark):
    total = {"fuel": "total", "actual": 1000.0}
    text = generation(
        interval("a", {"fuel": "wind", "perc": 20.0, "actual": 7.0}, total),
        interval("b", WIND, {"fuel": "all"}, total),
        interval("c", WIND),
        interval("d", total),
        interval("e", {"fuel": "wind"}, total),
    )
    good = documents.check_documents(landed(spark, text), "text", GENERATION_DOCUMENT, "data").good
    rows = documents.megawatt_series(good).collect()
    assert {r.datetime: r.wind_mw for r in rows} == {"a": 7.0, "b": 200.0}


def test_empty_and_null_mix(spark):
    schema = struct({"id": T.IntegerType(), "mix": T.ArrayType(MIX_ENTRY)})
    df = spark.createDataFrame([(0, []), (1, None)], schema)
    rows = df.select(documents.fuel_share(F.col("mix")).alias("x"), documents.fuel_megawatts(F.col("mix")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows] == [(None, None), (None, None)]


def test_bad_documents_are_quarantined(spark):
    df = landed(spark, generation(interval("2024-01-01T00:00Z", WIND)), "{broken", '{"error": 1}', "[]", None)
    checked = documents.check_documents(df, "text", GENERATION_DOCUMENT, "data")
    assert [r.id for r in checked.good.collect()] == [0]
    assert {r.id: r.reason for r in checked.quarantine.collect()}.keys() == {1, 2, 3, 4}
    assert {r.id: r.reason for r in checked.quarantine.collect()}[2] == "missing data"


def test_weather_arrays(spark):
    full = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None], "wind_speed_10m": [3.0]}}
    df = landed(spark, json.dumps(full), json.dumps({"other": 1}))
    good = documents.check_documents(df, "text", WEATHER_DOCUMENT, "hourly").good
    rows = documents.weather_series(good).orderBy("datetime").collect()
    assert [tuple(r) for r in rows] == [
        (datetime(2024, 1, 1, 0), 1.5, 3.0),
        (datetime(2024, 1, 1, 1), None, None),
    ]
    filled = documents.filled_weather(df, "text", until=date(2024, 1, 1)).orderBy("datetime").collect()
    assert [r.temperature_2m for r in filled] == [1.5, 1.5]
    assert documents.filled_weather(df, "text", until=date(2023, 12, 31)).isEmpty()


def test_first_reading_per_timestamp_is_kept(spark):
    df = landed(
        spark,
        generation(interval("2024-01-01T00:00Z", WIND)),
        generation(interval("2024-01-01T00:00Z", {"fuel": "wind", "perc": 99.0}), interval("2024-01-01T00:30Z", WIND)),
    )
    rows = documents.history_of_share(df, "text", order=["id"]).orderBy("datetime").collect()
    assert [r.wind_perc for r in rows] == [20.0, 20.0]


def test_first_reading_inside_a_document_is_kept(spark):
    readings = ({"fuel": "wind", "perc": p} for p in (30.0, 10.0, 20.0))
    df = landed(spark, generation(*(interval("2024-01-01T00:00Z", r) for r in readings)))
    assert [r.wind_perc for r in documents.history_of_share(df, "text", ["id"]).collect()] == [30.0]
    with pytest.raises(ValueError, match="order"):
        documents.history_of_share(df, "text", [])


def test_training_reader_keeps_intervals_without_mix(spark):
    df = landed(spark, generation(interval("2024-01-01T00:00Z"), interval("2024-01-01T00:30Z", WIND)))
    kept = documents.history_of_share(df, "text", ["id"], need_mix=False).orderBy("datetime").collect()
    assert [r.wind_perc for r in kept] == [None, 20.0]
    assert documents.history_of_share(df, "text", ["id"]).count() == 1


def test_weather_without_times_is_quarantined(spark):
    df = landed(spark, *map(json.dumps, ({"hourly": {"temperature_2m": [1.0]}}, {"hourly": {"time": []}}, {})))
    checked = documents.check_documents(df, "text", WEATHER_DOCUMENT, documents.WEATHER_REQUIRED)
    assert sorted(r.reason for r in checked.quarantine.collect()) == ["missing hourly", "missing hourly.time"]
    assert checked.good.count() == 1


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2018-05-15T12:00Z", datetime(2018, 5, 15, 12)),
        ("2024-01-01T00:00", datetime(2024, 1, 1)),
        ("2024-01-01T00:00+01:00", datetime(2023, 12, 31, 23)),
        ("2024-01-01T00:00:30Z", datetime(2024, 1, 1, 0, 0, 30)),
        ("2024-13-01T00:00Z", None),
        ("soon", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(parse_utc(F.col("t")).alias("x")).first().x == expected


def tiles(df):
    return [(r.first_day, r.last_day) for r in df.orderBy("first_day").collect()]


def test_tiles(spark):
    span = manifest.range_of(spark, date(2023, 11, 20), date(2024, 1, 10))
    assert tiles(manifest.day_tiles(span, 30)) == [
        (date(2023, 11, 20), date(2023, 12, 19)),
        (date(2023, 12, 20), date(2024, 1, 10)),
    ]
    assert tiles(manifest.year_tiles(span)) == [
        (date(2023, 11, 20), date(2023, 12, 31)),
        (date(2024, 1, 1), date(2024, 1, 10)),
    ]
    months = [(date(2023, 11, 1), date(2023, 11, 30)), (date(2023, 12, 1), date(2023, 12, 31)), (date(2024, 1, 1), date(2024, 1, 31))]
    assert tiles(manifest.month_tiles(span)) == months
    stored = spark.createDataFrame([(date(2023, 12, 1),)], "month DATE")
    assert tiles(manifest.missing_months(span, stored)) == [months[0], months[2]]
    turned = manifest.range_of(spark, date(2024, 2, 2), date(2024, 1, 1))
    for cut in (manifest.day_tiles, manifest.month_tiles, manifest.year_tiles):
        assert tiles(cut(turned)) == []


def test_absent_table_is_empty_with_schema(spark, tmp_path):
    df = tables.read_table(spark, str(tmp_path / "none"), WEATHER_SERIES, ["datetime", "wind_speed_10m"])
    assert df.columns == ["datetime", "wind_speed_10m"] and df.isEmpty()
    assert not tables.table_exists(spark, str(tmp_path / "none"))
    assert not tables.restore(spark, str(tmp_path / "none"), str(tmp_path / "to"))


def test_series_write_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = [(datetime(2024, m, d), float(m)) for m in (1, 2, 3) for d in (1, 2)]
    df = spark.createDataFrame(rows, "datetime TIMESTAMP, x DOUBLE")
    tables.write_series(df, path)
    tables.write_series(df.where("month(datetime) = 2 AND day(datetime) = 1").withColumn("x", F.lit(9.0)), path)
    back = {r.datetime: r.x for r in spark.read.parquet(path).collect()}
    assert back == {t: 9.0 if t.month == 2 else x for t, x in rows if (t.month, t.day) != (2, 2)}
    some = tables.read_range(spark, path, date(2024, 2, 1), date(2024, 3, 2))
    assert sorted(r.datetime for r in some.collect()) == [datetime(2024, 2, 1), datetime(2024, 3, 1)]
    pruned = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in pruned and "PushedFilters: [IsNotNull(datetime)" in pruned


def test_snapshot_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    tables.snapshot_once(spark.range(3), path)
    tables.snapshot_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_metrics_documents_tolerate_gaps(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"holdout_rmse_perc": 1.5, "best_params": {"depth": 6}}, indent=4))
    (tmp_path / "bad.json").write_text("{ not json")
    good = metrics.read_document(spark, str(tmp_path / "good.json"), HOLDOUT_METRICS).collect()
    assert [(r.holdout_rmse_perc, r.holdout_mape_perc, r.best_params) for r in good] == [(1.5, None, {"depth": "6"})]
    for name in ("bad.json", "none.json"):
        df = metrics.read_document(spark, str(tmp_path / name), HOLDOUT_METRICS)
        assert df.collect() == [] and df.columns == HOLDOUT_METRICS.fieldNames()


def test_cv_document_keeps_fold_order(spark, tmp_path):
    folds = spark.createDataFrame([(2, 3.0, 0.3), (1, 1.0, 0.1)], "fold INT, rmse DOUBLE, mape DOUBLE")
    path = str(tmp_path / "cv")
    metrics.write_document(metrics.cv_document(folds), path)
    row = metrics.read_document(spark, path, CV_METRICS).first()
    assert (row.mean_rmse_perc, row.std_rmse_perc) == (2.0, 1.0)
    assert row.folds.rmse_perc == [1.0, 3.0] and row.folds.mape_perc == [0.1, 0.3]


def test_training_log(spark, tmp_path):
    (tmp_path / "learn.tsv").write_text("iter\tRMSE\n0\t14.5\n1\t3.25\n2\t2.5\n")
    (tmp_path / "test.tsv").write_text("iter\tRMSE\n0\t15.0\n1\t2.5\n2\t2.5\n")
    log = metrics.training_log(spark, str(tmp_path / "learn.tsv"), str(tmp_path / "test.tsv"))
    assert [tuple(r) for r in log.orderBy("iter").collect()] == [(0, 14.5, 15.0), (1, 3.25, 2.5), (2, 2.5, 2.5)]
    assert tuple(metrics.best_iteration(log).first()) == (1, 2.5)


def test_training_time(spark, tmp_path):
    (tmp_path / "time.tsv").write_text("iter\tPassed\tRemaining\n0\t12\t260\n1\t24\t120\n2\t30\t0\n")
    log = metrics.training_time(spark, str(tmp_path / "time.tsv"))
    assert [tuple(r) for r in log.orderBy("iter").collect()] == [(0, 12, 260), (1, 24, 120), (2, 30, 0)]
    assert tuple(metrics.time_report(log).first()) == (3, 30, 10.0, 242)
    assert metrics.time_report(log.limit(0)).isEmpty()


@pytest.fixture
def clock(spark, tmp_path, monkeypatch):
    """Events of users (3, 6, … 120; user n has n % 5 + 1) under a folder, and the plans of logs written meanwhile."""
    rows = [(i, datetime(2024, 1, 1), user, "a", 1.0, None) for user in range(3, 121, 3) for i in range(user % 5 + 1)]
    events = spark.createDataFrame(rows, ingest.EVENT_COLUMNS)
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    plans, csv = [], DataFrameWriter.csv
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, path: (plans.append(plan(self._df)), csv(self, path))[1])
    monkeypatch.setattr(ingest, "running_sums", partial(running_sums, chunk_rows=7), raising=False)
    return str(tmp_path), plans


def test_time_report_of_a_clock_over_several_chunks(spark, clock):
    folder, plans = clock
    (report,) = ingest.time_report(spark, folder).collect()
    passed = 1000 * sum(user % 5 + 1 for user in range(3, 121, 3))
    assert tuple(report) == (118, passed, round(passed / 118 + 3.1e-8, 6), 0)
    assert len(plans) == 1 and "unboundedfollowing" not in plans[0]  # a frame that would be summed anew for every row


def test_training_time_over_several_chunks(spark, clock):
    folder, plans = clock
    passed, expected = 0, []
    whole = 1000 * sum(user % 5 + 1 for user in range(3, 121, 3))
    for user in range(3, 121, 3):
        passed += 1000 * (user % 5 + 1)
        expected.append((user, passed, whole - passed))
    log = ingest.training_time(spark, folder)
    assert [tuple(r) for r in log.orderBy("iter").collect()] == expected
    # One task gathers a row per chunk, never one per user.
    (lines,) = [text.splitlines() for text in plans]
    gathered = [n for n, line in enumerate(lines) if "SinglePartition" in line]
    assert all("HashAggregate(keys=[_chunk" in lines[n + 1] for n in gathered)


def test_training_time_of_users_without_an_id_and_of_no_events(spark, tmp_path):
    rows = [(i, None, user, "a", 1.0, None) for i, user in enumerate([7, None, 7, None, None, 2])]
    events = spark.createDataFrame(rows, ingest.EVENT_COLUMNS)
    events.write.parquet(str(tmp_path / "some/events.parquet"))
    events.limit(0).write.parquet(str(tmp_path / "none/events.parquet"))
    log = ingest.training_time(spark, str(tmp_path / "some"))
    assert {tuple(r) for r in log.collect()} == {(None, 3000, 3000), (2, 4000, 2000), (7, 6000, 0)}
    assert ingest.training_time(spark, str(tmp_path / "none")).isEmpty()
    assert ingest.time_report(spark, str(tmp_path / "none")).isEmpty()


def test_feature_list():
    spec = FeatureSpec()
    assert len(spec.inputs) == len(set(spec.inputs)) == 28
    assert spec.reach == 95
    assert not set(spec.excluded) & set(spec.inputs)
