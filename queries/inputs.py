"""Input tables of the queries, in Spark and as SQL fragments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators.ordered import with_windows
from gridcast.operators.ranges import years
from gridcast.schemas import FeatureSpec

KEYS = ["event_type"]
SPEC = FeatureSpec(keys=("event_type",))

# The days (month, day) that the holiday calendar of the queries holds every year.
HOLIDAYS = ((1, 1), (12, 25), (12, 26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as an instant named `datetime` and no negative zeros."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("datetime"),
        "user_id",
        "event_type",
        (F.col("value") + F.lit(0.0)).alias("value"),
        "props",
    )


EVENTS = "events_ AS (SELECT event_id, ts AS datetime, user_id, event_type, value + 0.0 AS value, props FROM events)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type: mean value and event count of each hour that has events."""
    hour = F.date_trunc("HOUR", F.col("datetime")).alias("datetime")
    return (
        events(spark, sf_dir)
        .groupBy("event_type", hour)
        .agg(F.avg("value").alias("speed"), F.count(F.lit(1)).alias("n"))
    )


HOURLY = (
    "hourly AS (SELECT event_type, date_trunc('hour', ts) AS datetime, avg(value + 0.0) AS speed, "
    "CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2)"
)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series with the value one row ago as forecast and 48 rows ago as baseline."""
    return with_windows(
        hourly(spark, sf_dir),
        KEYS,
        ["datetime"],
        48,
        lambda df, w: df.withColumns(
            {"prediction": F.lag("speed", 1).over(w), "baseline": F.lag("speed", 48).over(w)}
        ),
        unique=True,
    )


FORECASTS = (
    HOURLY
    + ", forecasts AS (SELECT *, lag(speed, 1) OVER w AS prediction, lag(speed, 48) OVER w AS baseline "
    "FROM hourly WINDOW w AS (PARTITION BY event_type ORDER BY datetime))"
)


def calendar(spark: SparkSession, df: DataFrame, ts: str) -> DataFrame:
    """A holiday calendar `day, name` over the years that the times of `df` span."""
    days = [(date(year, m, d), "holiday") for year in years(df, ts) for m, d in HOLIDAYS]
    return spark.createDataFrame(days, "day date, name string")


IS_HOLIDAY = "(" + " OR ".join(f"(month({{0}}) = {m} AND day({{0}}) = {d})" for m, d in HOLIDAYS) + ")"


def feature_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Generation (raw events), weather (hourly series) and holidays for the feature plan."""
    raw = events(spark, sf_dir)
    generation = raw.select("event_type", "datetime", F.col("value").alias("wind_perc"), "event_id")
    weather = hourly(spark, sf_dir).select(
        "event_type",
        "datetime",
        F.col("n").cast("double").alias("temperature_2m"),
        F.col("speed").alias("wind_speed_10m"),
    )
    return generation, weather, calendar(spark, raw, "datetime")
