"""Analysis table and the two reports drawn from it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.metrics import skill_columns, with_skill
from gridcast.functions.scalars import (
    change_text,
    minute_text,
    number_text,
    percent_text,
    round_half_even,
    signed_error,
)
from gridcast.operators.columns import ensure_columns, newest
from gridcast.operators.folds import stride_sample
from gridcast.operators.merge import outer_merge, override
from gridcast.operators.ranges import closed_days, days_around, every_hours, trailing
from gridcast.schemas import BASELINE, PREDICTION, TARGET, TIME

SERIES = (TARGET, BASELINE, PREDICTION)


def analysis_table(
    history: DataFrame,
    full: DataFrame,
    latest: DataFrame,
    on: Sequence[str] = (TIME,),
    days: tuple[date, date] | None = None,
) -> DataFrame:
    """Actual, baseline and prediction per timestamp; latest predictions replace older ones.

    A filter on the merged key does not pass through an outer join, so a report that needs only
    some days gives them here, where they reach the scans.
    """
    if days is not None:
        history, full, latest = (closed_days(df, TIME, *days) for df in (history, full, latest))
    merged = outer_merge(history, override(full, latest, on), on)
    return ensure_columns(merged, {c: "double" for c in SERIES}).select(*on, *SERIES)


def error_series(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Prediction minus actual wherever both are known."""
    error = signed_error(F.col(PREDICTION), F.col(TARGET))
    return table.select(*keys, TIME, error.alias("prediction_error")).where("prediction_error IS NOT NULL")


def skill(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE and MAPE of model and baseline with status, arrow, change and display texts."""
    metrics = skill_columns(TARGET, PREDICTION, BASELINE)
    kpis = with_skill(table.groupBy(*keys).agg(*metrics) if keys else table.agg(*metrics))
    texts = {}
    for who in ("model", "baseline"):
        texts[f"{who}_rmse_text"] = number_text(F.col(f"{who}_rmse"), 2)
        texts[f"{who}_mape_text"] = number_text(F.col(f"{who}_mape") * F.lit(100.0), 1)
    texts["rmse_change_text"] = change_text(F.col("rmse_change"), 0)
    texts["mape_change_text"] = change_text(F.col("mape_change"), 1)
    return kpis.withColumns(texts)


def recent_baseline(history: DataFrame) -> DataFrame:
    """Skill of the persistence baseline over the day up to the latest actual."""
    recent = trailing(history, TIME, TARGET)
    return ensure_columns(recent, {PREDICTION: "double"}).agg(
        *skill_columns(TARGET, PREDICTION, BASELINE)[2:]
    )


def trend(table: DataFrame, keys: Sequence[str] = (), value: str = TARGET, last: int = 12) -> DataFrame:
    """Do the later half of the `last` values lie above the earlier half? One row per series.

    With an odd count the middle value is in neither half. Equal means point down. Series with
    fewer than two values give no row. The row number filter keeps `last` rows per series
    already before the shuffle.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.desc(TIME))
    known = table.where(F.col(value).isNotNull()).select(*keys, TIME, value)
    if keys:
        known = known.withColumn("_back", F.row_number().over(newest_first)).where(F.col("_back") <= last)
    else:
        known = newest(known, [TIME], last).withColumn("_back", F.row_number().over(newest_first))
    counted = known.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    half = F.expr("_n DIV 2")
    halves = (
        counted.where("_n >= 2")
        .groupBy(*keys)
        .agg(
            F.avg(F.when(F.col("_back") > F.col("_n") - half, F.col(value))).alias("earlier_mean"),
            F.avg(F.when(F.col("_back") <= half, F.col(value))).alias("later_mean"),
        )
    )
    rising = F.col("later_mean") > F.col("earlier_mean")
    result = halves.withColumns(
        {
            "direction": F.when(rising, "↑").otherwise("↓"),
            "trend_status": F.when(rising, "success").otherwise("danger"),
            "gap": round_half_even(F.abs(F.col("later_mean") - F.col("earlier_mean")), 1),
        }
    )
    # A global aggregate yields a row even for no input.
    return result if keys else result.where("later_mean IS NOT NULL")


def value_table(table: DataFrame, keys: Sequence[str] = (), rows: int = 8, step: int = 6) -> DataFrame:
    """The newest rows at full steps of `step` hours, formatted for display."""
    shown = newest(every_hours(table, TIME, step), [TIME, *keys], rows)
    return shown.select(
        *keys,
        minute_text(F.col(TIME)).alias("timestamp"),
        percent_text(round_half_even(F.col(TARGET))).alias("actual"),
        percent_text(round_half_even(F.col(PREDICTION))).alias("predicted"),
    )


def sampled_values(table: DataFrame, keys: Sequence[str] = (), points: int = 8) -> DataFrame:
    """Evenly spaced rows of the whole range, formatted for display."""
    # Positions need an order over all rows, so only the columns shown take part in it.
    shown = table.select(*keys, TIME, TARGET, PREDICTION)
    return stride_sample(shown, [TIME, *keys], points).select(
        *keys,
        minute_text(F.col(TIME)).alias("timestamp"),
        round_half_even(F.col(TARGET)).alias("actual"),
        round_half_even(F.col(PREDICTION)).alias("predicted"),
    )


class RangeReport:
    """KPIs, error series and sample of some rows. Each part is planned when it is first asked for."""

    def __init__(self, rows: DataFrame, keys: Sequence[str] = ()):
        self.rows, self.keys = rows, keys

    @cached_property
    def kpis(self) -> DataFrame:
        return skill(self.rows, self.keys)

    @cached_property
    def errors(self) -> DataFrame:
        return error_series(self.rows, self.keys)

    @cached_property
    def sample(self) -> DataFrame:
        return sampled_values(self.rows, self.keys)


def range_report(table: DataFrame, start: date, end: date, keys: Sequence[str] = ()) -> RangeReport:
    """The report of the days `start` to `end`."""
    return RangeReport(closed_days(table, TIME, start, end), keys)


class ForecastReport:
    """Rows, error series, value table and trend. Each part is planned when it is first asked for."""

    def __init__(self, rows: DataFrame, keys: Sequence[str] = ()):
        self.rows, self.keys = rows, keys

    @cached_property
    def errors(self) -> DataFrame:
        return error_series(self.rows, self.keys)

    @cached_property
    def values(self) -> DataFrame:
        return value_table(self.rows, self.keys)

    @cached_property
    def trend(self) -> DataFrame:
        return trend(self.rows, self.keys)


def forecast_report(table: DataFrame, as_of: date, keys: Sequence[str] = ()) -> ForecastReport:
    """The last three days and the next two around `as_of`."""
    return ForecastReport(closed_days(table, TIME, *days_around(as_of)), keys)


def forecast_kpis(stored: DataFrame, history: DataFrame) -> DataFrame:
    """Cards of the forecast: the stored holdout metrics of the model against the recent baseline.

    `stored` is the metrics document, of one row, or of none when no model was evaluated yet; then
    the cards cannot be compared. One row with status, arrow and change.
    """
    found = stored.select("holdout_rmse_perc", "holdout_mape_perc").first() or (None, None)
    model = {f"model_{name}": F.lit(v).cast("double") for name, v in zip(("rmse", "mape"), found)}
    return with_skill(recent_baseline(history).withColumns(model))
