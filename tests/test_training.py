from __future__ import annotations

import math
import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.ml import PipelineModel

from gridcast.plans import training
from gridcast.plans.features import engineer_features
from gridcast.plans.history import read_history
from gridcast.plans.nightly import EmptySource, Tables, nightly
from gridcast.schemas import HOLDOUT_METRICS, FeatureSpec
from gridcast.sources.tables import table_exists, write_table

START = datetime(2024, 1, 1)
QUICK = training.TreeParams(iterations=3, depth=2, bins=16)
SPEC = FeatureSpec()


@pytest.fixture(scope="module")
def raw(spark):
    random_ = random.Random(5)
    hours = [START + timedelta(hours=h) for h in range(400)]
    speeds = [8 + 6 * math.sin(h / 9) + random_.uniform(-1, 1) for h in range(400)]
    weather = spark.createDataFrame(
        [(t, 5.0, s) for t, s in zip(hours, speeds)], "datetime TIMESTAMP, temperature_2m DOUBLE, wind_speed_10m DOUBLE"
    )
    shares = spark.createDataFrame(
        [(t, 2 * s) for t, s in zip(hours[:370], speeds)], "datetime TIMESTAMP, wind_perc DOUBLE"
    )
    holidays = spark.createDataFrame([(date(2024, 1, 1), "new year")], "day DATE, name STRING")
    return shares, weather, holidays


@pytest.fixture(scope="module")
def features(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features"))
    write_table(engineer_features(*raw), path)
    return spark.read.parquet(path)


def test_train_scores_every_known_row_and_the_holdout(spark, features, tmp_path):
    trained = training.train(features, SPEC, QUICK)
    known = features.where("wind_perc IS NOT NULL")
    assert trained.full_predictions.columns == ["datetime", "wind_perc_pred"]
    assert trained.full_predictions.count() == known.count()
    held = trained.holdout.collect()
    assert len(held) == 48 and min(r.datetime for r in held) > START + timedelta(hours=300)
    row = training.holdout_metrics(trained).first()
    assert 0 < row.holdout_rmse_perc < 10 and row.best_params == {}
    assert training.holdout_metrics(trained).schema.names == HOLDOUT_METRICS.fieldNames()
    # Rows without a target can be scored too, and a stored model scores the same.
    training.save_model(trained.model, str(tmp_path / "model"))
    again = training.score(training.load_model(spark, str(tmp_path / "model")), features)
    assert again.count() == features.count()
    both = again.join(trained.full_predictions.withColumnRenamed("wind_perc_pred", "p"), "datetime")
    assert both.where("p <> wind_perc_pred").isEmpty()


def test_no_known_target_is_refused(features):
    with pytest.raises(ValueError, match="no rows"):
        training.train(features.where("wind_perc IS NULL"), SPEC, QUICK)


def test_cross_validation(features):
    result = training.cross_validate(features, SPEC, QUICK, n_splits=2)
    assert [r.fold for r in result.metrics.orderBy("fold").collect()] == [1, 2]
    summary = training.fold_summary(result.metrics).first()
    assert summary.mean_rmse > 0 and summary.std_rmse >= 0
    ranked = training.rank_importance(result.importance, 5).collect()
    assert len(ranked) == 5 and ranked[0].mean_importance >= ranked[-1].mean_importance > -1
    total = result.importance.groupBy("fold").sum("importance").collect()
    assert all(r[1] == pytest.approx(1.0) for r in total)


def test_search_ranks_trials_and_survives_failures(features, monkeypatch):
    space = training.SearchSpace(iterations=(1, 2), depth=(1, 2), bins=(32, 40))
    results = training.search(features, SPEC, space, trials=2, n_splits=2, seed=7)
    rows = results.collect()
    assert len(rows) == 2 and rows[0].folds == 2 and rows[1].mean_rmse < math.inf
    best = training.best_params(results)
    assert best.depth == rows[0].depth and best.learning_rate == rows[0].learning_rate

    def broken(*args):
        raise RuntimeError("no fit")

    monkeypatch.setattr(training, "fit", broken)
    assert [r.mean_rmse for r in training.search(features, SPEC, space, trials=1, n_splits=2).collect()] == [math.inf]


def test_best_round_waits_for_its_patience():
    errors = [5.0, 4.0, 4.5, 4.2, 3.9, 4.0, 4.0, 4.0, 1.0]
    assert training.best_round(errors, 2) == 2
    assert training.best_round(errors, 3) == 5
    assert training.best_round(errors, 50) == 9
    assert training.best_round([1.0, 1.0], 50) == 1


def test_slow_learning_keeps_many_rounds(features):
    rows = features.where("wind_perc IS NOT NULL")
    first = rows.where("datetime < timestamp'2024-01-13'")
    last = rows.where("datetime >= timestamp'2024-01-13'")
    params = training.TreeParams(iterations=25, depth=3, learning_rate=0.01, bins=32)
    model, error = training.fit_best(first, last, SPEC.inputs, SPEC.target, params)
    full = training.fit(first, SPEC.inputs, SPEC.target, params)
    shaped = full.stages[0].transform(training._inputs(last, SPEC.inputs))
    errors = full.stages[-1].evaluateEachIteration(shaped, "squared")
    assert model.stages[-1].getNumTrees > 15
    assert error == pytest.approx(math.sqrt(min(errors)))
    scored = training.predict(model, last, SPEC.inputs)
    squared = scored.selectExpr("sqrt(avg(pow(wind_perc_pred - wind_perc, 2))) AS e").first().e
    assert squared == pytest.approx(error)


def test_nightly_run_keeps_its_tables_safe(spark, raw, features, tmp_path):
    shares, weather, holidays = raw
    model = training.train(features, SPEC, QUICK).model
    tables = Tables.under(str(tmp_path))
    write_table(features, tables.features)
    for emptied in range(3):
        sources = [shares, weather, weather]
        sources[emptied] = sources[emptied].limit(0)
        with pytest.raises(EmptySource):
            nightly(spark, date(2024, 1, 16), tables, *sources, holidays, model)
    assert spark.read.parquet(tables.features).count() == features.count()
    assert not table_exists(spark, tables.snapshot) and read_history(spark, tables.history) is None
    # No rows of the run's days: nothing is overwritten, and what was there is the snapshot now.
    nightly(spark, date(2030, 1, 1), tables, shares, weather, weather, holidays, model)
    assert spark.read.parquet(tables.features).count() == features.count()
    assert spark.read.parquet(tables.snapshot).count() == features.count()
    assert not table_exists(spark, tables.predictions)


def test_search_space_is_seeded_and_within_bounds():
    space = training.SearchSpace()
    draws = [space.draw(random.Random(1)) for _ in range(2)]
    assert draws[0] == draws[1]
    generator = random.Random(2)
    for params in (space.draw(generator) for _ in range(50)):
        assert 500 <= params.iterations <= 4000 and 4 <= params.depth <= 11 and 32 <= params.bins <= 255
        assert 0.01 <= params.learning_rate <= 0.2 and 0.6 <= params.subsample <= 1.0


@pytest.mark.parametrize("days", [3, None])
def test_nightly_run(spark, raw, features, tmp_path, days):
    shares, weather, holidays = raw
    as_of = date(2024, 1, 16)
    model = training.train(features, SPEC, QUICK).model
    tables = Tables.under(str(tmp_path))
    run = [spark, as_of, tables, shares, weather, weather, holidays, model]
    predictions = nightly(*run, days=days)
    times = sorted(r.datetime for r in predictions.collect())
    # With three days of history the first 48 hours only serve as lags.
    assert times[0] == datetime(2024, 1, 15 if days else 13) and times[-1] == datetime(2024, 1, 17, 15)
    history = read_history(spark, tables.history)
    assert history.count() == len(times)
    nightly(*run, days=days)
    assert read_history(spark, tables.history).count() == len(times)
    history = read_history(spark, tables.history)
    if days is None:
        full = features.join(history.select("datetime"), "datetime", "left_semi")
        assert full.select(sorted(full.columns)).exceptAll(history.select(sorted(full.columns))).isEmpty()


def test_categories_are_marked_and_split_as_sets(spark):
    """Levels b, d, f are high and a, c, e low: no order of the letters tells them apart by one cut."""
    rows = [(letter, float(i % 3), 10.0 if letter in "bdf" else 0.0) for i in range(60) for letter in "abcdef"]
    df = spark.createDataFrame([*rows, *[(None, 0.0, 5.0)] * 60], "kind string, x double, y double")
    params = training.TreeParams(iterations=1, depth=2, bins=16)
    model = training.fit(df, ["x", "kind"], "y", params, categories=["kind"])
    shaped = PipelineModel(model.stages[:-1]).transform(training._inputs(df, ["x", "kind"], ["kind"]))
    marked = shaped.schema["features"].metadata["ml_attr"]["attrs"]["nominal"]
    assert [a["name"] for a in marked] == ["_in_kind"] and marked[0]["vals"][:6] == list("abcdef") and len(marked[0]["vals"]) == 7
    scored = {r.kind: r.wind_perc_pred for r in training.predict(model, df, ["x", "kind"]).collect()}
    assert scored == {**dict.fromkeys("bdf", 10.0), **dict.fromkeys("ace", 0.0), None: 5.0}
    unknown = spark.createDataFrame([("z", 1.0)], "kind string, x double")
    assert training.predict(model, unknown, ["x", "kind"]).first().wind_perc_pred == 5.0


def test_holidays_are_a_category_of_the_default_model(features):
    model = training.train(features, SPEC, QUICK).model
    assert training._marked(model) == ["is_holiday"]


@pytest.mark.parametrize("categories", [(), ("is_holiday",)])
def test_first_rounds_equal_a_fit_of_so_many(spark, features, tmp_path, categories):
    rows = features.where("wind_perc IS NOT NULL")
    long = training.TreeParams(iterations=9, depth=3, bins=16, subsample=0.8)
    whole = training.fit(rows, SPEC.inputs, SPEC.target, long, categories)
    cut = training.first_rounds(whole, 4)
    short = training.fit(rows, SPEC.inputs, SPEC.target, replace(long, iterations=4), categories)
    scores = [{r.datetime: r.wind_perc_pred for r in training.predict(m, rows, SPEC.inputs).collect()} for m in (cut, short)]
    assert scores[0] == scores[1] and cut.stages[-1].getNumTrees == 4
    assert training.first_rounds(whole, 9) is whole
    weights = cut.stages[-1].featureImportances.toArray()
    assert weights == pytest.approx(short.stages[-1].featureImportances.toArray()[: len(weights)])
    training.save_model(cut, str(tmp_path / "cut"))
    again = training.predict(training.load_model(spark, str(tmp_path / "cut")), rows, SPEC.inputs)
    assert {r.datetime: r.wind_perc_pred for r in again.collect()} == scores[1]


def test_one_fit_per_fold(features, monkeypatch):
    fits, plain = [], training.fit
    monkeypatch.setattr(training, "fit", lambda *a, **k: fits.append(1) or plain(*a, **k))
    training.cross_validate(features, SPEC, training.TreeParams(iterations=4, depth=2, bins=16), n_splits=2)
    assert len(fits) == 2


@pytest.mark.parametrize("parallel", [1, 3])
def test_dropped_trials_cannot_win(features, monkeypatch, parallel):
    errors = {0: [3.0, 3.0, 3.0], 1: [9.5, 1.0, 1.0], 2: [1.0, 2.0, 3.0], 3: [3.0, 2.9, 0.2], 4: [6.1, 0.0, 0.0]}
    space = training.SearchSpace()
    generator = random.Random(1)
    known = [space.draw(generator, 1) for _ in errors]
    calls = []

    def error(train, test, spec, params):
        trial = known.index(params)
        calls.append(trial)
        return errors[trial][calls.count(trial) - 1]

    monkeypatch.setattr(training, "best_error", error)
    ranked = {}
    for drop in (False, True):
        calls.clear()
        found = training.search(features, SPEC, space, len(errors), n_splits=3, seed=1, parallel=parallel, drop=drop).collect()
        whole = [(r.trial, r.mean_rmse) for r in found if r.folds == 3]
        means = {t: sum(e) / 3 for t, e in errors.items()}
        assert whole == sorted(((t, means[t]) for t, _ in whole), key=lambda x: (x[1], x[0]))
        assert all(r.mean_rmse > means[2] for r in found if r.folds < 3)
        ranked[drop] = found[0].trial
        assert len(found) == 5 and (drop or len(whole) == 5)
    assert ranked == {False: 2, True: 2}
    if parallel == 1:
        assert calls.count(1) == 1  # 9.5 / 3 is more than the 3.0 of trial 0
