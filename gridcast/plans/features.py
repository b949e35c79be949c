"""The feature plan: two raw series to model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridcast.functions.scalars import calendar_columns, power_curve
from gridcast.operators.asof import nearest_join, pick_join_strategy
from gridcast.operators.columns import complete_rows, ensure_columns, spare
from gridcast.operators.merge import flag_members
from gridcast.operators.ordered import CHUNK_ROWS, MAX_GROUP_ROWS, pick_strategy, with_windows
from gridcast.operators.windows import lag_columns, with_rolling
from gridcast.schemas import FeatureSpec
from gridcast.session import require_utc
from gridcast.sources.tables import snapshot_once, write_table


def engineer_features(
    generation: DataFrame,
    weather: DataFrame,
    holidays: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    generation_order: Sequence[str] = (),
    strategy: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Weather rows with the nearest generation value and all model inputs.

    Rows that lack a predictor (the first rows of a series, missing weather) are dropped; rows
    that lack only the target or its lags stay, since those are the ones to forecast.

    With series of moderate length the join and all windows run on one hash partitioning by
    series. The join keeps the weather rows as they are, so the sizes measured on the narrow
    inputs also bound the window groups. With longer ones the rows are numbered once, for the join;
    the windows go on from the numbers that the join gives the weather rows.

    `unique` is that of `nearest_join`: stated, no row has to be hashed.
    """
    require_utc(weather.sparkSession)
    keys = list(spec.keys)
    weather = ensure_columns(weather, {c: "double" for c in spec.weather})
    windows = strategy
    if strategy == "auto":
        strategy = pick_join_strategy(weather, generation, spec.time, keys, max_group_rows=max_group_rows)
        windows = "series" if strategy == "series" else pick_strategy(weather, keys, "auto", max_group_rows)
    place, row = spare({*weather.columns, *generation.columns}, "_place", "_row")
    aligned = nearest_join(
        weather,
        generation,
        on=spec.time,
        keys=keys,
        right_order=generation_order,
        values=[spec.target],
        strategy=strategy,
        chunk_rows=chunk_rows,
        unique=unique,
        place=place,
        row=row,
    )
    powered = aligned.withColumns(power_curve(F.col(spec.speed), spec.rated_speed))

    def add(rows: DataFrame, window: WindowSpec) -> DataFrame:
        lags = {
            **lag_columns(window, spec.target, spec.target, spec.lag_rows),
            **lag_columns(window, spec.speed, "wind_speed", spec.lag_rows),
        }
        return with_rolling(rows.withColumns(lags), window, spec.speed, "wind_speed", spec.rolling_rows)

    shifted = with_windows(
        powered,
        keys,
        [spec.time],
        spec.reach,
        add,
        strategy=windows,
        chunk_rows=chunk_rows,
        tie=place,
        row=row if strategy == "ordered" else None,
    )
    dated = shifted.withColumns(calendar_columns(F.col(spec.time)))
    flagged = flag_members(dated, F.to_date(spec.time), holidays)
    return complete_rows(flagged, spec.predictors).select(*keys, spec.time, spec.target, *spec.inputs)


def store_features(generation: DataFrame, weather: DataFrame, holidays: DataFrame, path: str, **options) -> None:
    """Replace the feature table at `path`.

    Without any input an existing table is left alone, and an absent one is created empty.
    """
    features = engineer_features(generation, weather, holidays, **options)
    if weather.isEmpty() and generation.isEmpty():
        snapshot_once(features, path)
    else:
        write_table(features, path)


def features_for(mode: str, tables: dict[str, tuple[DataFrame, DataFrame]], holidays: DataFrame, **options):
    """The same plan over the inputs of one mode, such as `training` or `inference`."""
    if mode not in tables:
        raise ValueError(f"unknown mode {mode!r}, expected one of {sorted(tables)}")
    generation, weather = tables[mode]
    return engineer_features(generation, weather, holidays, **options)
