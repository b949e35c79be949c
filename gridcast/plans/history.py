"""The rolling history of feature rows: resolve, extend, store."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gridcast.operators.dedupe import keep_last_of
from gridcast.sources.store import Change, Store

#: Name of the one table in the store of a history.
ROWS = "rows"


def upsert(history: DataFrame, new: DataFrame, keys: Sequence[str] = ("datetime",), order: Sequence[str] = ()) -> DataFrame:
    """History with `new` laid over it: one row per key, a new row wins, then the last in `order`."""
    return keep_last_of([history, new], keys, order)


def assemble_weather(past: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("datetime",), order: Sequence[str] = ()) -> DataFrame:
    """Observed and forecast weather as one series; the forecast wins where both exist."""
    return keep_last_of([past, forecast], keys, order)


def resolve_history(history: DataFrame | None, snapshot: DataFrame | None, new: DataFrame) -> DataFrame:
    """The base to extend: the history, or the snapshot if that is longer, or only new rows.

    The two counts read no column data from parquet, only row counts in the file footers.
    """
    if history is None:
        return snapshot if snapshot is not None else new
    if snapshot is not None and history.count() < snapshot.count():
        return snapshot
    return history


def upsert_table(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str] = ("datetime",),
    ts: str = "datetime",
    order: Sequence[str] = (),
    token: str | None = None,
) -> None:
    """Lay `new` over the history stored at `path`, in the months it touches.

    Merged months are written once, as new versions, and published in place of the old ones; see
    `Store`. A call that failed has changed nothing, one that is repeated with its token after it went
    through changes nothing more.

    The stored history holds each key once, as every call leaves it. So only the new rows are
    reduced to one per key, and a batch small enough to be broadcast moves no stored row but for the
    order of its file.
    """
    store, token = Store(spark, path), token or uuid.uuid4().hex
    if not store.has(token):
        store.publish(token, store.laid_over(ROWS, new, keys, ts, order))


def replace_table(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str] = ("datetime",), ts: str = "datetime") -> None:
    """Publish `rows` in place of the whole stored history."""
    Store(spark, path).publish(uuid.uuid4().hex, Change(ROWS, rows, ts, keys, replace="all"))


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The published history at `path`, None if there is none."""
    return Store(spark, path).read(ROWS)
