from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from plans import plan

from gridcast.plans.features import engineer_features, features_for, store_features
from gridcast.schemas import FeatureSpec

START = datetime(2024, 2, 26)
HOLIDAY = date(2024, 3, 1)
GENERATION = "site STRING, datetime TIMESTAMP, wind_perc DOUBLE"
WEATHER = "site STRING, datetime TIMESTAMP, temperature_2m DOUBLE, wind_speed_10m DOUBLE"
SPEC = FeatureSpec(keys=("site",))


def raw(seed=1, hours=160, future=12):
    """Hourly weather with gaps, half-hourly shares that end before the weather does."""
    random_ = random.Random(seed)
    weather, shares = [], []
    for site in ("north", "south"):
        for h in range(hours + future):
            if random_.random() < 0.05:
                continue
            speed = None if random_.random() < 0.01 else random_.uniform(-1, 25)
            weather.append((site, START + timedelta(hours=h), random_.uniform(-5, 15), speed))
        for half in range(2 * hours):
            if random_.random() < 0.7:
                at = START + timedelta(minutes=30 * half + random_.choice([0, 0, 7]))
                shares.append((site, at, random_.uniform(0, 60)))
    return shares, weather


def calendar(spark, *days):
    return spark.createDataFrame([(d, "holiday") for d in days], "day DATE, name STRING")


def by_pandas(shares, weather) -> pd.DataFrame:
    met = pd.DataFrame(weather, columns=["site", "datetime", "temperature_2m", "wind_speed_10m"]).sort_values("datetime")
    ci = pd.DataFrame(shares, columns=["site", "datetime", "wind_perc"]).sort_values("datetime")
    df = pd.merge_asof(met, ci, on="datetime", by="site", direction="nearest", tolerance=pd.Timedelta("30min"))
    df = df.sort_values(["site", "datetime"]).reset_index(drop=True)
    speed = df["wind_speed_10m"]
    df["wind_speed_v3"], df["wind_speed_v3_clip"] = speed**3, speed.clip(0, 15) ** 3
    for label, n in SPEC.lag_rows.items():
        df[f"wind_perc_lag_{label}"] = df.groupby("site")["wind_perc"].shift(n)
        df[f"wind_speed_lag_{label}"] = df.groupby("site")["wind_speed_10m"].shift(n)
    for label, n in SPEC.rolling_rows.items():
        window = df.groupby("site")["wind_speed_10m"].rolling(n, min_periods=1)
        df[f"wind_speed_roll_mean_{label}"] = window.mean().reset_index(level=0, drop=True)
        df[f"wind_speed_roll_std_{label}"] = window.std().reset_index(level=0, drop=True)
    when = df["datetime"].dt
    df["hour"], df["dayofweek"], df["dayofyear"] = when.hour, when.dayofweek, when.dayofyear
    for name, part, period in (("hour", df["hour"], 24), ("dayofyear", df["dayofyear"], 365.25)):
        df[f"sin_{name}"] = np.sin(2 * np.pi * part / period)
        df[f"cos_{name}"] = np.cos(2 * np.pi * part / period)
    df["is_holiday"] = (when.date == HOLIDAY).astype(int)
    df = df.dropna(subset=SPEC.predictors)
    return df[["site", "datetime", "wind_perc", *SPEC.inputs]].reset_index(drop=True)


@pytest.mark.parametrize("options", [{}, {"strategy": "ordered", "chunk_rows": 100}, {"max_group_rows": 60, "chunk_rows": 100}])
def test_features_equal_pandas(spark, options):
    shares, weather = raw()
    df = engineer_features(
        spark.createDataFrame(shares, GENERATION).repartition(3),
        spark.createDataFrame(weather, WEATHER).repartition(3),
        calendar(spark, HOLIDAY, HOLIDAY),
        SPEC,
        **options,
    )
    expected = by_pandas(shares, weather)
    rows = df.orderBy("site", "datetime").collect()
    got = pd.DataFrame([r.asDict() for r in rows], columns=df.columns)
    assert got.columns.tolist() == expected.columns.tolist()
    assert got[["site", "datetime"]].astype(str).equals(expected[["site", "datetime"]].astype(str))
    numbers = got.columns[2:]
    np.testing.assert_allclose(got[numbers].astype(float), expected[numbers].astype(float), atol=1e-6)
    assert expected["wind_perc"].isna().any() and expected["is_holiday"].any()


def test_rows_to_forecast_stay_and_first_rows_go(spark):
    weather = [("s", START + timedelta(hours=h), 1.0, 5.0 + h % 3) for h in range(60)]
    shares = [("s", START + timedelta(hours=h), 10.0) for h in range(50)]
    df = engineer_features(
        spark.createDataFrame(shares, GENERATION), spark.createDataFrame(weather, WEATHER), calendar(spark), SPEC
    )
    rows = df.orderBy("datetime").collect()
    assert [r.datetime for r in rows] == [START + timedelta(hours=h) for h in range(48, 60)]
    # The tolerance of half an hour is inclusive, whole hours past the last reading find none.
    assert [r.wind_perc for r in rows] == [10.0] * 2 + [None] * 10
    assert rows[-1].wind_perc_lag_3h is None and rows[-1].wind_perc_lag_24h == 10.0
    assert {r.is_holiday for r in rows} == {0}


def test_calendar_parts(spark):
    days = [datetime(2024, 1, 1, 5), datetime(2024, 12, 31, 23)]
    rows = []
    for i, day in enumerate(days):
        rows += [(f"s{i}", day - timedelta(hours=h), 1.0, 5.0 + h % 2) for h in range(49)]
    df = engineer_features(
        spark.createDataFrame([], GENERATION), spark.createDataFrame(rows, WEATHER), calendar(spark), SPEC
    )
    found = {r.site: (r.hour, r.dayofweek, r.dayofyear) for r in df.collect()}
    assert found == {"s0": (5, 0, 1), "s1": (23, 1, 366)}


def test_one_site_without_key_and_empty_inputs(spark):
    shares, weather = raw(2, 100, 0)
    north = [w[1:] for w in weather if w[0] == "north"]
    met = spark.createDataFrame(north, WEATHER.removeprefix("site STRING, "))
    none = spark.createDataFrame([], GENERATION.removeprefix("site STRING, "))
    df = engineer_features(none, met, calendar(spark))
    assert df.columns[:2] == ["datetime", "wind_perc"] and not df.isEmpty()
    assert df.where("wind_perc IS NOT NULL").isEmpty()
    empty = engineer_features(none, met.limit(0), calendar(spark))
    assert empty.isEmpty() and empty.schema.names == df.schema.names
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in FeatureSpec().feature_schema()]


def test_modes_share_the_plan(spark):
    shares, weather = raw(3, 100, 0)
    inputs = (spark.createDataFrame(shares, GENERATION), spark.createDataFrame(weather, WEATHER))
    df = features_for("training", {"training": inputs}, calendar(spark), spec=SPEC)
    assert not df.isEmpty()
    with pytest.raises(ValueError, match="unknown mode"):
        features_for("other", {"training": inputs}, calendar(spark))


def test_another_session_zone_is_refused(spark):
    shares, weather = raw(5, 10, 0)
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        with pytest.raises(ValueError, match="need UTC"):
            engineer_features(
                spark.createDataFrame(shares, GENERATION), spark.createDataFrame(weather, WEATHER), calendar(spark)
            )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stored_features_survive_a_run_without_input(spark, tmp_path):
    shares, weather = raw(6, 60, 0)
    ci, met = spark.createDataFrame(shares, GENERATION), spark.createDataFrame(weather, WEATHER)
    path, holidays = str(tmp_path / "features"), calendar(spark)
    nothing = (ci.limit(0), met.limit(0), holidays, path)
    store_features(*nothing, spec=SPEC)
    assert spark.read.parquet(path).count() == 0
    store_features(ci, met, holidays, path, spec=SPEC)
    rows = spark.read.parquet(path).count()
    store_features(*nothing, spec=SPEC)
    assert spark.read.parquet(path).count() == rows > 0


def test_series_plan_has_one_shuffle_and_two_sorts(spark):
    shares, weather = raw(4, 60, 0)
    df = engineer_features(
        spark.createDataFrame(shares, GENERATION), spark.createDataFrame(weather, WEATHER), calendar(spark, HOLIDAY), SPEC
    )
    text = plan(df)
    assert text.count("Exchange hashpartitioning(site") == 1
    assert text.count("Sort [site") == 2
    assert "SinglePartition" not in text and "NestedLoop" not in text


def test_ordered_plan_numbers_the_rows_once(spark, monkeypatch):
    from gridcast.operators import ordered

    written, plain = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, label="table": written.append(plan(df)) or plain(df, label))
    shares, weather = raw(4, 60, 0)
    df = engineer_features(
        spark.createDataFrame(shares, GENERATION), spark.createDataFrame(weather, WEATHER), calendar(spark, HOLIDAY), SPEC,
        strategy="ordered", chunk_rows=100,
    )
    assert sum(p.count("rangepartitioning") for p in [*written, plan(df)]) == 1 and len(written) == 1


def test_unique_inputs_are_not_hashed(spark):
    shares, weather = raw(4, 60, 0)
    frames = spark.createDataFrame(shares, GENERATION), spark.createDataFrame(weather, WEATHER), calendar(spark, HOLIDAY)
    assert "xxhash64" in plan(engineer_features(*frames, SPEC)) and "xxhash64" not in plan(engineer_features(*frames, SPEC, unique=True))
