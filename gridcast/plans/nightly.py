"""One nightly run: landed documents to features, history and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from gridcast.operators.dedupe import keep_last_of
from gridcast.operators.ordered import fill_gaps
from gridcast.operators.ranges import closed_days, until_end_of_day
from gridcast.plans.features import engineer_features
from gridcast.plans.history import assemble_weather, read_history, replace_table, resolve_history, upsert_table
from gridcast.plans.intake import FORECAST_WEATHER, GENERATION, PAST_WEATHER, series
from gridcast.plans.training import score
from gridcast.schemas import FeatureSpec
from gridcast.session import materialize
from gridcast.sources.documents import filled_weather, history_of_share
from gridcast.sources.store import Store
from gridcast.sources.tables import PARTITIONS, snapshot_once, table_exists, write_table

HISTORY_DAYS = 3


class EmptySource(ValueError):
    """A source of the run has no rows."""


@dataclass(frozen=True)
class Landed:
    """Documents as they landed: frames with the spec's keys, a text column and the order they came in."""

    generation: DataFrame
    past_weather: DataFrame
    forecast_weather: DataFrame
    text: str = "text"
    order: tuple[str, ...] = ("id",)


@dataclass(frozen=True)
class Tables:
    """Where a run keeps its tables."""

    snapshot: str
    history: str
    features: str
    predictions: str

    @staticmethod
    def under(root: str) -> Tables:
        root = root.rstrip("/")
        return Tables(f"{root}/snapshot", f"{root}/history", f"{root}/features", f"{root}/predictions")


def nightly(
    spark: SparkSession,
    as_of: date,
    tables: Tables,
    generation: DataFrame,
    past_weather: DataFrame,
    forecast_weather: DataFrame,
    holidays: DataFrame,
    model: PipelineModel,
    spec: FeatureSpec = FeatureSpec(),
    generation_order: Sequence[str] = (),
    days: int | None = None,
) -> DataFrame:
    """Build the features of the run, lay them over the history, score them.

    Returns the predictions, which are also stored. Stops with `EmptySource`, all tables untouched,
    when a source has no rows. The features that a first run finds are kept as the snapshot before
    it overwrites them. A run without feature rows leaves history and predictions as they are.
    """
    sources = {"generation": generation, "past weather": past_weather, "forecast weather": forecast_weather}
    for name, source in sources.items():
        if source.isEmpty():
            raise EmptySource(f"no rows of {name}")
    if not table_exists(spark, tables.snapshot) and table_exists(spark, tables.features):
        snapshot_once(spark.read.parquet(tables.features), tables.snapshot)

    features = run_features(
        as_of, generation, past_weather, forecast_weather, holidays, spec, generation_order, days
    )
    features = materialize(features, "run-features")
    scored = score(model, features, spec)
    if features.isEmpty():
        return scored
    write_table(features, tables.features)
    extend_history(spark, tables, features, spec)
    write_table(scored, tables.predictions)
    return spark.read.parquet(tables.predictions)


def nightly_from_documents(
    spark: SparkSession,
    as_of: date,
    tables: Tables,
    documents: Landed,
    holidays: DataFrame,
    model: PipelineModel,
    spec: FeatureSpec = FeatureSpec(),
    days: int | None = None,
) -> DataFrame:
    """The nightly run from landed documents: parse, check, fill, then `nightly`."""
    keys = list(spec.keys)
    generation = history_of_share(documents.generation, documents.text, documents.order, keys)
    past = filled_weather(documents.past_weather, documents.text, keys)
    ahead = filled_weather(documents.forecast_weather, documents.text, keys, until=as_of + timedelta(days=1))
    parts = (materialize(part, "landed") for part in (generation, past, ahead))
    return nightly(spark, as_of, tables, *parts, holidays, model, spec, days=days)


def nightly_from_store(
    spark: SparkSession,
    as_of: date,
    tables: Tables,
    store: Store,
    holidays: DataFrame,
    model: PipelineModel,
    spec: FeatureSpec = FeatureSpec(),
    days: int | None = None,
) -> DataFrame:
    """The nightly run from the series of all documents that were ever taken in (see `plans.intake`)."""
    sources = []
    for feed in (GENERATION, PAST_WEATHER, FORECAST_WEATHER):
        rows = series(store, feed)
        if rows is None:
            raise EmptySource(f"no rows of {feed.name}")
        sources.append(rows)
    generation, *weather = sources
    filled = [fill_gaps(rows, list(spec.keys), [spec.time], list(spec.weather), unique=True) for rows in weather]
    return nightly(spark, as_of, tables, generation, *(materialize(f, "filled") for f in filled), holidays, model, spec, days=days)


def run_features(
    as_of: date,
    generation: DataFrame,
    past_weather: DataFrame,
    forecast_weather: DataFrame,
    holidays: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    generation_order: Sequence[str] = (),
    days: int | None = None,
) -> DataFrame:
    """Feature rows from some days before `as_of` to the end of the day after it.

    Past weather ends before `as_of`, measured generation with that day, and the forecast covers
    it and the next. With `days` set only that much history feeds the windows, which truncates
    the longer ones; `None` lets them see everything and keeps the recent rows afterwards.
    """
    first, last = as_of - timedelta(days=days or HISTORY_DAYS), as_of + timedelta(days=1)
    start = first if days is not None else date.min
    past = closed_days(past_weather, spec.time, start, as_of - timedelta(days=1))
    measured = closed_days(generation, spec.time, start, as_of)
    ahead = closed_days(until_end_of_day(forecast_weather, spec.time, last), spec.time, as_of, last)
    weather = assemble_weather(past, ahead, [*spec.keys, spec.time])
    features = engineer_features(measured, weather, holidays, spec, generation_order)
    return features if days is not None else closed_days(features, spec.time, first, last)


def extend_history(spark: SparkSession, tables: Tables, features: DataFrame, spec: FeatureSpec = FeatureSpec()) -> None:
    """Start the history from the snapshot if there is none or it is shorter, then lay `features` over it."""
    keys = [*spec.keys, spec.time]
    history = read_history(spark, tables.history)
    snapshot = spark.read.parquet(tables.snapshot) if table_exists(spark, tables.snapshot) else None
    base = resolve_history(history, snapshot, features)
    if base is not history:
        start = keep_last_of([base.drop(*PARTITIONS)], keys)
        replace_table(spark, tables.history, start, keys, spec.time)
    upsert_table(spark, tables.history, features, keys, spec.time)
