"""Splits and samples by position in time order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.operators.columns import content_hash, spare
from gridcast.operators.ordered import ordered_rows

#: Bins of a histogram, and rows of one bin that one task ranks.
BINS = 4096
RANKED_ROWS = 100_000


@dataclass(frozen=True)
class Fold:
    """Positions: training rows are [0, train_end), test rows [test_start, test_end)."""

    fold: int
    train_end: int
    test_start: int
    test_end: int

    def role(self, row: Column) -> Column:
        """`train`, `test` or NULL for a row outside the fold."""
        return F.when(row < self.train_end, "train").when(
            (row >= self.test_start) & (row < self.test_end), "test"
        )


def walk_forward_folds(total: int, n_splits: int = 5, test_size: int = 48, gap: int = 0) -> list[Fold]:
    """Expanding folds whose test blocks tile the end of the rows without overlap."""
    first = total - n_splits * test_size
    if test_size < 1 or first - gap <= 0:
        raise ValueError(
            f"{n_splits} folds of {test_size} test rows and a gap of {gap} leave no training rows out of {total}"
        )
    return [
        Fold(number, start - gap, start, start + test_size)
        for number, start in enumerate(range(first, total, test_size), start=1)
    ]


def fraction_rows(total: int, fraction: float = 0.15) -> int:
    return int(total * fraction)


def walk_forward(
    df: DataFrame,
    order: Sequence[str],
    n_splits: int = 5,
    test_size: int | None = None,
    fraction: float | None = None,
    gap: int = 0,
    roles: Sequence[str] = ("train", "test"),
) -> DataFrame:
    """One row per fold and row with one of the `roles` in it: `fold`, `role`, `row` and the columns.

    Training rows recur in every later fold; `roles=["test"]` alone keeps each row at most once.
    """
    indexed = ordered_rows(df, order, "row")
    size = test_size if test_size is not None else fraction_rows(indexed.total, fraction or 0.15)
    folds = walk_forward_folds(indexed.total, n_splits, size, gap)
    row = F.col("row")
    parts = F.array(
        *(F.struct(F.lit(f.fold).alias("fold"), f.role(row).alias("role")) for f in folds)
    )
    return (
        indexed.df.withColumn("_part", F.explode(F.filter(parts, lambda p: p.role.isin(*roles))))
        .select("_part.fold", "_part.role", *indexed.df.columns)
    )


def holdout_split(df: DataFrame, order: Sequence[str], test_size: int = 48) -> DataFrame:
    """Column `role`: `holdout` for the last `test_size` rows of the order, `train` before them.

    Only the position of one row matters, so a top-n finds it and every row is then compared
    with that literal: no sort and no shuffle of the data. Rows equal in `order` follow a hash of
    their content, so that exactly `test_size` rows are held out; only exact copies of the row at
    the edge stay together.
    """
    (tie,) = spare(df.columns, "_tie")
    order = [*order, tie]
    df = df.withColumn(tie, content_hash(df))
    last = df.select(*order).orderBy(*map(F.desc, order)).limit(test_size)
    first = last.orderBy(*order).first()
    if first is None:
        return df.withColumn("role", F.lit("train")).drop(tie)
    held = F.when(_at_or_after(order, first), "holdout").otherwise("train")
    return df.withColumn("role", held).drop(tie)


def _at_or_after(order: Sequence[str], row) -> Column:
    """Lexicographic `order >= row`, its leading column bare so that scans can prune by it."""
    *rest, last = order
    condition = F.col(last) >= F.lit(row[last])
    for name in reversed(rest):
        value = F.lit(row[name])
        condition = (F.col(name) > value) | ((F.col(name) == value) & condition)
    return condition


def stride_sample(df: DataFrame, order: Sequence[str], points: int = 8) -> DataFrame:
    """Every k-th row of the order, k = max(1, rows // points), up to `points` of them.

    Keeps the position as `row`. Only few positions are asked for, so the rows are counted and not
    sorted; see `rows_at`.
    """
    total = df.count()
    step = max(1, total // points)
    return rows_at(df, order, [k * step for k in range(points) if k * step < total])


def rows_at(df: DataFrame, order: Sequence[str], positions: Sequence[int], most: int = RANKED_ROWS) -> DataFrame:
    """The rows at the given positions of ascending `order` (NULL first), with the position as `row`.

    Histograms over the first order column, a time or a whole number, lead to the stretches of values
    that the positions lie in: a stretch is divided into bins, and a bin with more than `most` rows is a
    stretch again. Only rows of the last stretches are shuffled, and each is ranked by itself. One value
    with more than `most` rows is sorted by the rest of the order, over several tasks. Rows equal in
    `order` follow a hash of their content. Orders that begin with anything else are sorted as a whole.
    """
    first = order[0]
    tie, bin_, before_ = spare([*df.columns, "row"], "_tie", "_bin", "_before")
    tied = df.withColumn(tie, content_hash(df))
    scale = _scale(df.schema[first].dataType, F.col(first))
    if scale is None:
        return ordered_rows(tied, order, "row", tie=tie).df.where(F.col("row").isin(list(positions))).drop(tie)

    missing = df.where(F.col(first).isNull()).count() if positions else 0
    low, high = df.agg(F.min(scale), F.max(scale)).first() if positions else (None, None)
    # Values from low to high (both None: NULL), how many rows precede them, how many they are, what is asked.
    todo = [(None, None, 0, missing, [p for p in positions if p < missing])]
    if low is not None:
        todo.append((low, high, missing, None, [p for p in positions if p >= missing]))
    small, large = [], []
    while todo:
        low, high, before, size, asked = todo.pop()
        if not asked:
            continue
        within = F.col(first).isNull() if low is None else scale.between(low, high)
        if size is not None and size <= most:
            small.append((within, before))
        elif low == high:
            large.append((within, before))
        else:
            bins = df.where(within).groupBy(F.floor((scale - F.lit(low)) / -(-(high - low + 1) // BINS)).alias(bin_))
            counts = bins.agg(F.min(scale).alias("low"), F.max(scale).alias("high"), F.count(F.lit(1)).alias("n"))
            for own in sorted(counts.drop(bin_).collect()):  # a few more than BINS at most
                inside = [p for p in asked if before <= p < before + own["n"]]
                todo += [(*own[:2], before, own["n"], inside)] if inside else []
                before += own["n"]

    start = F.lit(None).cast("long")
    for within, before in small:
        start = F.when(within, F.lit(before).cast("long")).otherwise(start)
    ranked = tied.withColumn(before_, start).where(F.col(before_).isNotNull())
    place = F.row_number().over(Window.partitionBy(before_).orderBy(*order, tie)) - 1
    out = ranked.withColumn("row", F.col(before_) + place).drop(before_, tie)
    for within, before in large:
        own = ordered_rows(tied.where(within), order, "row", tie=tie).df.drop(tie)
        out = out.unionByName(own.withColumn("row", F.col("row") + before))
    return out.where(F.col("row").isin(list(positions)))


def _scale(kind: T.DataType, column: Column) -> Column | None:
    """The column as a whole number of the same order, if it can be."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    return column.cast("long") if isinstance(kind, T.IntegralType) else None
