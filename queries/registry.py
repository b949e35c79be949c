"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.session import use_utc

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


NUDGE = 3.1e-8

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query. Its result is tidied: zone-less timestamps, doubles at six places."""

    def register(build: Run) -> Run:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(use_utc(spark), sf_dir))

        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, run, sql)
        return run

    return register


def tidy(df: DataFrame) -> DataFrame:
    changed = {}
    for column in df.schema:
        if isinstance(column.dataType, T.TimestampType):
            changed[column.name] = F.col(column.name).cast("timestamp_ntz")
        elif isinstance(column.dataType, T.DoubleType):
            # The nudge takes exact ties at the sixth place away from the order of summation,
            # and adding zero turns a negative zero into a plain one.
            changed[column.name] = F.round(F.col(column.name) + F.lit(NUDGE), 6) + F.lit(0.0)
    return df.withColumns(changed) if changed else df


def r6(expression: str) -> str:
    """SQL for a double as `tidy` leaves it."""
    return f"(round({expression} + {NUDGE}, 6) + 0.0)"
