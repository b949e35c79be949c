"""Column selection, presence, completeness and shape."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without(df: DataFrame, *names: str) -> DataFrame:
    """All columns but `names`; names the frame lacks are ignored."""
    return df.drop(*names)


def content_hash(df: DataFrame, names: Iterable[str] | None = None) -> Column:
    """A hash of a row's content, the last resort where an order leaves rows equal.

    Spark does not hash maps, so whatever holds one is hashed as its JSON text.
    """
    chosen = set(df.columns if names is None else names)
    parts = [
        F.to_json(F.struct(F.col(f"`{f.name}`"))) if _holds_map(f.dataType) else F.col(f"`{f.name}`")
        for f in df.schema
        if f.name in chosen
    ]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)


def spare(names: Iterable[str], *wanted: str) -> list[str]:
    """For each wanted name one that is not among `names`: helper columns must not meet a caller's."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def matching(df: DataFrame, pattern: str, keep: bool = True) -> list[str]:
    """Names that contain the pattern, or with `keep=False` those that do not."""
    return [c for c in df.columns if bool(re.search(pattern, c)) == keep]


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the named columns as NULLs of the given type where the frame lacks them."""
    missing = {name: kind for name, kind in columns.items() if name not in df.columns}
    if not missing:
        return df
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in missing.items()})


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN means missing in the raw data; aggregates here skip NULL only."""
    floats = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without NULL (or NaN) in any of the columns."""
    return df.dropna(subset=list(columns))


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """`df` itself, or ValueError when it is empty. Reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    return df


def unpivot_series(df: DataFrame, ids: Sequence[str], series: Sequence[str]) -> DataFrame:
    """Wide to long: one row per id and chosen series, as `variable` and `value`."""
    return df.unpivot(list(ids), list(series), "variable", "value")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column as rows `column_name, nulls`, from one pass over the data."""
    columns = list(columns or df.columns)
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([], columns, "column_name", "nulls")


def preview(df: DataFrame, order: Sequence[str], n: int = 5, last: bool = False) -> DataFrame:
    """The first or last `n` rows of the order, by a bounded top-n and no full sort."""
    return df.orderBy(*(F.desc(c) for c in order) if last else order).limit(n)


def newest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The `n` rows latest in the order."""
    return preview(df, order, n, last=True)
