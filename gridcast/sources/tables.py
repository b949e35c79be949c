"""Parquet and CSV tables: tolerant scans, time-partitioned sinks, snapshots, exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.operators.ranges import half_open

PARTITIONS = ("year", "month")


def table_exists(spark: SparkSession, path: str) -> bool:
    return _open(spark, path) is not None


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None
) -> DataFrame:
    """The chosen columns of a parquet table, or an empty frame of that shape if there is none."""
    df = _open(spark, path, schema)
    if df is None:
        df = spark.createDataFrame([], schema)
    return df.select(*(columns or schema.fieldNames()))


def _open(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def first_filled(*sources: DataFrame) -> DataFrame:
    """The first source that holds a row, else the last one. Reads at most one row of each."""
    for source in sources[:-1]:
        if not source.isEmpty():
            return source
    return sources[-1]


def with_months(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def write_series(
    df: DataFrame, path: str, ts: str = "datetime", order: Sequence[str] = (), replace: bool = False
) -> None:
    """Write month partitions, overwriting only the months in `df`, or with `replace` the table.

    Rows are range partitioned in table order, so that a month that holds most of the data is
    written by many tasks and a task writes few months. `order` breaks ties within a timestamp.
    """
    placed = ["year", "month", *[c for c in order if c != ts], ts]
    (
        with_months(df, ts)
        .repartitionByRange(*placed)
        .sortWithinPartitions(*placed)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if replace else "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_range(
    spark: SparkSession, path: str, start: date | datetime, end: date | datetime, ts: str = "datetime"
) -> DataFrame:
    """`start <= ts < end` of a table from `write_series`, touching only the months in between.

    The planner cannot derive the month partitions from a timestamp filter, so both are given.
    """
    month = F.col("year") * 12 + F.col("month")
    table = spark.read.parquet(path).where(
        month.between(start.year * 12 + start.month, end.year * 12 + end.month)
    )
    return half_open(table, ts, _moment(start), _moment(end)).drop(*PARTITIONS)


def _moment(day: date | datetime) -> datetime:
    return day if isinstance(day, datetime) else datetime(day.year, day.month, day.day)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a whole table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def snapshot_once(df: DataFrame, path: str) -> None:
    """Keep `df` as a snapshot unless there already is one."""
    df.write.mode("ignore").parquet(path)


def restore(spark: SparkSession, snapshot: str, path: str) -> bool:
    """Replace a table by its snapshot; False when there is no snapshot."""
    df = _open(spark, snapshot)
    if df is None:
        return False
    write_table(df, path)
    return True


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; timestamps as ISO text."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
