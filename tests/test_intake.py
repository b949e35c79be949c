from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest

from gridcast.plans import training
from gridcast.plans.intake import FORECAST_WEATHER, GENERATION, LEDGER, PAST_WEATHER, series, take_in
from gridcast.plans.nightly import EmptySource, Tables, nightly_from_store
from gridcast.schemas import FeatureSpec
from gridcast.sources.store import Store

START = datetime(2024, 1, 1)


def share(*readings):
    """Readings are (hour, percentage)."""
    data = [
        {"from": f"{START + timedelta(hours=h):%Y-%m-%dT%H:%MZ}", "generationmix": [{"fuel": "wind", "perc": p}]} for h, p in readings
    ]
    return json.dumps({"data": data})


def weather(hours, speed, gaps=()):
    times = [f"{START + timedelta(hours=h):%Y-%m-%dT%H:%M}" for h in hours]
    speeds = [None if h in gaps else float(speed(h)) for h in hours]
    return json.dumps({"hourly": {"time": times, "temperature_2m": [5.0] * len(times), "wind_speed_10m": speeds}})


def landed(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def readings(store):
    return {int((r.datetime - START).total_seconds() // 3600): r.wind_perc for r in series(store, GENERATION).collect()}


def test_each_document_is_taken_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = share((0, 10.0), (1, 11.0)), share((1, 99.0), (2, 12.0))
    first = take_in(store, GENERATION, landed(spark, one, one, "{broken"), "a")
    assert sorted(r.reason or "" for r in first.collect()) == ["", "malformed"]
    assert readings(store) == {0: 10.0, 1: 11.0}
    again = take_in(store, GENERATION, landed(spark, "{broken", one, two), "b")
    assert again.count() == 1
    assert readings(store) == {0: 10.0, 1: 11.0, 2: 12.0}  # the first reading of an hour stays
    assert store.rows(LEDGER) == 3


def test_same_text_of_another_feed_or_series_is_another_document(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    text = weather(range(3), lambda h: h)
    for feed in (PAST_WEATHER, FORECAST_WEATHER):
        take_in(store, feed, landed(spark, text), feed.name)
    assert store.rows(LEDGER) == 2 and store.rows("past_weather") == store.rows("forecast_weather") == 3
    sites = spark.createDataFrame([("a", 1, text), ("b", 1, text), ("b", 2, text)], "site string, id long, text string")
    other = Store(spark, str(tmp_path / "sites"))
    take_in(other, PAST_WEATHER, sites, "sites", keys=["site"])
    assert other.rows(LEDGER) == 2 and other.rows("past_weather") == 6


@pytest.mark.parametrize("fails", ["rows", "ledger", "manifest"])
def test_rerun_after_a_failure_equals_one_run(spark, tmp_path, monkeypatch, fails):
    batches = [[share((0, 10.0), (800, 1.0))], [share((0, 99.0), (5, 5.0)), "{broken"], [share((6, 6.0))]]
    once = Store(spark, str(tmp_path / "once"))
    for n, texts in enumerate(batches):
        take_in(once, GENERATION, landed(spark, *texts), f"{n}")
    store = Store(spark, str(tmp_path / "store"))
    take_in(store, GENERATION, landed(spark, *batches[0]), "0")
    before, write = readings(store), Store._write

    def failing(self, change):
        if change is None or (fails == "rows") == (change.name != LEDGER):
            raise OSError("executor lost")
        return write(self, change)

    with monkeypatch.context() as broken:
        if fails == "manifest":  # all data are written, the last step fails
            broken.setattr(Store, "_switch", lambda *args: failing(None, None))
        else:
            broken.setattr(Store, "_write", failing)
        with pytest.raises(OSError):
            take_in(store, GENERATION, landed(spark, *batches[1]), "1")
    assert readings(store) == before and store.rows(LEDGER) == 1
    for n in (1, 2):
        take_in(store, GENERATION, landed(spark, *batches[n]), f"{n}")
        take_in(store, GENERATION, landed(spark, *batches[n]), f"{n}")
    assert readings(store) == readings(once) == {0: 10.0, 800: 1.0, 5: 5.0, 6: 6.0}
    assert store.rows(LEDGER) == once.rows(LEDGER) == 4


def test_later_weather_wins_and_nothing_landed_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert series(store, PAST_WEATHER) is None
    take_in(store, PAST_WEATHER, landed(spark), "none")
    assert series(store, PAST_WEATHER) is None
    take_in(store, PAST_WEATHER, landed(spark, weather(range(4), lambda h: h), weather(range(2, 5), lambda h: 10 * h)), "a")
    take_in(store, PAST_WEATHER, landed(spark, weather(range(4, 6), lambda h: -h), None), "b")
    speeds = [r.wind_speed_10m for r in series(store, PAST_WEATHER).orderBy("datetime").collect()]
    assert speeds == [0.0, 1.0, 20.0, 30.0, -4.0, -5.0]


def test_landed_documents_to_predictions(spark, tmp_path):
    """Documents in two landings, one of them twice: the same predictions as from all of them at once."""
    spec, hours = FeatureSpec(), range(24 * 16)
    power = [share(*((h, float(h % 37)) for h in hours if part[0] <= h < part[1])) for part in ((0, 200), (190, 384))]
    past = [weather(range(a, b), lambda h: h % 23, gaps={7, 8}) for a, b in ((0, 200), (150, 360))]
    ahead = [weather(range(360, 420), lambda h: h % 19)]
    holidays = spark.createDataFrame([(date(2024, 1, 1), "x")], "day date, name string")
    results = []
    for name, landings in (("split", (0, 1, 1)), ("whole", (None,))):
        store = Store(spark, str(tmp_path / name / "store"))
        tables = Tables.under(str(tmp_path / name / "tables"))
        with pytest.raises(EmptySource):
            nightly_from_store(spark, date(2024, 1, 16), tables, store, holidays, None)
        for n, at in enumerate(landings):
            for feed, texts in ((GENERATION, power), (PAST_WEATHER, past), (FORECAST_WEATHER, ahead)):
                take_in(store, feed, landed(spark, *(texts if at is None else texts[at : at + 1])), f"{feed.name}{n}")
        if not results:
            from gridcast.plans.features import engineer_features

            features = engineer_features(series(store, GENERATION), series(store, PAST_WEATHER).fillna(1.0), holidays, spec)
            model = training.fit(features.where("wind_perc IS NOT NULL"), spec.inputs, spec.target, training.TreeParams(iterations=2, depth=2))
        predictions = nightly_from_store(spark, date(2024, 1, 16), tables, store, holidays, model)
        results.append({r.datetime: r.wind_perc_pred for r in predictions.collect()})
    assert results[0] == results[1] and max(results[0]) == datetime(2024, 1, 17, 23)
