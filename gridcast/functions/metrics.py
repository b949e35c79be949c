"""Forecast metrics as aggregate Columns: one pass over the rows, NULL pairs left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the smallest denominator of a relative error (double-precision machine epsilon).
EPSILON = 2.220446049250313e-16


def rmse(actual: Column, predicted: Column) -> Column:
    error = predicted - actual
    return F.sqrt(F.avg(error * error))


def mape(actual: Column, predicted: Column, zero: str = "epsilon") -> Column:
    """Mean absolute relative error as a fraction.

    Zero actuals divide by a tiny epsilon, which blows the mean up; `zero="exclude"` leaves
    those rows out instead.
    """
    size = F.abs(actual)
    if zero == "exclude":
        return F.avg(F.try_divide(F.abs(predicted - actual), size))
    if zero != "epsilon":
        raise ValueError(f"unknown treatment of zero actuals: {zero!r}")
    # greatest() skips NULL; the numerator keeps such pairs NULL.
    return F.avg(F.abs(predicted - actual) / F.greatest(size, F.lit(EPSILON)))


def guarded(metric: Column, actual: Column, predicted: Column) -> Column:
    """The metric where there is more than one complete pair, else NULL."""
    return F.when(F.count(predicted - actual) > 1, metric)


def skill_columns(actual: str, prediction: str, baseline: str) -> list[Column]:
    """Guarded RMSE and MAPE of model and baseline, all four in the same pass."""
    y = F.col(actual)
    return [
        guarded(metric(y, F.col(other)), y, F.col(other)).alias(f"{who}_{name}")
        for who, other in (("model", prediction), ("baseline", baseline))
        for name, metric in (("rmse", rmse), ("mape", mape))
    ]


def status(value: Column, base: Column, lower_better: bool = True) -> Column:
    """`success`, `danger`, `warning` (equal) or `secondary` (not comparable)."""
    better, worse = (value < base, value > base) if lower_better else (value > base, value < base)
    return (
        F.when(value.isNull() | base.isNull(), "secondary")
        .when(better, "success")
        .when(worse, "danger")
        .otherwise("warning")
    )


def arrow(value: Column, base: Column) -> Column:
    """Direction of the value against the base; it does not depend on which one is better."""
    return (
        F.when(value.isNull() | base.isNull(), "")
        .when(value < base, "↓")
        .when(value > base, "↑")
        .otherwise("=")
    )


def relative_change(value: Column, base: Column) -> Column:
    """(value − base) / base, NULL for a zero base."""
    return F.try_divide(value - base, base)


def relative_gain(value: Column, base: Column) -> Column:
    """(base − value) / base, the opposite sign."""
    return F.try_divide(base - value, base)


def with_skill(df, names=("rmse", "mape")):
    """Status, arrow and change of `model_*` against `baseline_*` for each metric."""
    columns = {}
    for name in names:
        model, base = F.col(f"model_{name}"), F.col(f"baseline_{name}")
        columns[f"{name}_status"] = status(model, base)
        columns[f"{name}_arrow"] = arrow(model, base)
        columns[f"{name}_change"] = relative_change(model, base)
    return df.withColumns(columns)
