"""Row-based lag and rolling columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def lag_columns(window: WindowSpec, column: str, prefix: str, rows: Mapping[str, int]) -> dict[str, Column]:
    """`{prefix}_lag_{label}`: the value that many rows earlier, gaps in time not counted."""
    return {f"{prefix}_lag_{label}": F.lag(column, n).over(window) for label, n in rows.items()}


def persistence(window: WindowSpec, column: str, rows: int = 48) -> Column:
    """The baseline forecast: the value observed `rows` rows ago."""
    return F.lag(column, rows).over(window)


def with_rolling(
    df: DataFrame,
    window: WindowSpec,
    column: str,
    prefix: str,
    rows: Mapping[str, int],
    stats: Sequence[str] = ("mean", "std"),
) -> DataFrame:
    """Mean and sample deviation over the current and the n − 1 rows before it.

    NULLs are skipped and one value is enough for a mean; the deviation of one value is NULL.

    A row frame would add up all n values again for every row. Instead, the moments of 2, 4, 8, …
    rows are merged from two halves, the older one read by a lag, and a length between the powers
    of two from its binary parts. That takes a few lags per row, of which all share one sort, and
    merging moments, unlike subtracting running totals, loses no precision.
    """
    x = f"double(`{column}`)"
    columns_before = df.columns
    single = f"named_struct('n', double(isnotnull({x})), 'mean', coalesce({x}, 0D), 'm2', 0D)"
    df = df.withColumn("__span1", F.expr(single))
    merges, results = _merges(set(rows.values()))
    ready = {"__span1"}
    while merges:
        # Merges that do not wait for each other read their lags in one window.
        now = [m for m in merges if {m.newer, m.older} <= ready]
        merges = [m for m in merges if m not in now]
        ready |= {m.out for m in now}
        df = _merge(df, window, now)

    columns = {}
    for label, n in rows.items():
        span = results[n]
        if "mean" in stats:
            columns[f"{prefix}_roll_mean_{label}"] = F.expr(f"if({span}.n > 0, {span}.mean, NULL)")
        if "std" in stats:
            deviation = f"if({span}.n > 1, sqrt({span}.m2 / ({span}.n - 1)), NULL)"
            columns[f"{prefix}_roll_std_{label}"] = F.expr(deviation)
    return df.select(*columns_before, *(c.alias(name) for name, c in columns.items()))


@dataclass(frozen=True)
class _Merge:
    """The moments `out` cover those of `newer` and, that many `rows` before it, those of `older`."""

    out: str
    newer: str
    older: str
    rows: int


def _merges(lengths: set[int]) -> tuple[list[_Merge], dict[int, str]]:
    """The merges that lead from single rows to all lengths, and the name of each length."""
    merges, names = [], {}
    span = 1
    while 2 * span <= max(lengths):
        merges.append(_Merge(f"__span{2 * span}", f"__span{span}", f"__span{span}", span))
        span *= 2
    for n in lengths:
        parts = [1 << bit for bit in range(n.bit_length()) if n >> bit & 1]
        covered = parts.pop()
        name = f"__span{covered}"
        while parts:
            part = parts.pop()
            longer = f"__span{n}_{covered + part}"
            merges.append(_Merge(longer, name, f"__span{part}", covered))
            name, covered = longer, covered + part
        names[n] = name
    return merges, names


def _merge(df: DataFrame, window: WindowSpec, merges: Sequence[_Merge]) -> DataFrame:
    """Moments are structs of count, mean and sum of squared deviations from the mean."""
    lags = {f"__old{m.out}": F.lag(m.older, m.rows).over(window) for m in merges}
    merged = {m.out: F.expr(_merged(m.newer, f"__old{m.out}")) for m in merges}
    return df.withColumns(lags).withColumns(merged)


def _merged(a: str, b: str) -> str:
    """SQL for the moments of `a` and `b` together; `b` is NULL before the start of the series."""
    b_n, b_mean, b_m2 = (f"coalesce({b}.{moment}, 0D)" for moment in ("n", "mean", "m2"))
    total = f"({a}.n + {b_n})"
    share = f"{b_n} / greatest({total}, 1D)"
    gap = f"({b_mean} - {a}.mean)"
    return (
        f"named_struct('n', {total}, 'mean', {a}.mean + {gap} * {share}, "
        f"'m2', {a}.m2 + {b_m2} + {gap} * {gap} * {a}.n * {share})"
    )
