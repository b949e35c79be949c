"""Landed JSON documents to rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.scalars import parse_utc
from gridcast.operators.columns import nan_to_null
from gridcast.operators.dedupe import keep_first
from gridcast.operators.ordered import fill_gaps
from gridcast.operators.ranges import until_end_of_day
from gridcast.schemas import GENERATION_DOCUMENT, WEATHER_DOCUMENT

CORRUPT = "_corrupt_record"
WEATHER_REQUIRED = ("hourly", "hourly.time")


# --- extraction from one document ---------------------------------------------------------


def first_entry(mix: Column, *fuels: str, having: str | None = None) -> Column:
    """The first entry of one of the fuels (with a value in `having`), NULL if there is none."""

    def wanted(entry: Column) -> Column:
        found = entry.fuel.isin(*fuels)
        return found & entry[having].isNotNull() if having else found

    return F.get(F.filter(mix, wanted), F.lit(0))


def fuel_share(mix: Column, fuel: str = "wind") -> Column:
    """Percentage of the first entry of a fuel."""
    return first_entry(mix, fuel)["perc"]


def fuel_megawatts(mix: Column, fuel: str = "wind") -> Column:
    """Measured output of a fuel, else its share of the total output, else NULL."""
    entry = first_entry(mix, fuel)
    total = first_entry(mix, "all", "total", having="actual")
    return F.coalesce(entry["actual"], total["actual"] * entry["perc"] / F.lit(100.0))


def columns_to_rows(df: DataFrame, document: str, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A struct of parallel arrays to one row per position; short arrays are padded with NULL."""
    zipped = F.arrays_zip(*(F.col(f"{document}.{name}").alias(name) for name in arrays))
    return df.select(*keep, F.inline(zipped).alias(*arrays))


# --- validation ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Checked:
    good: DataFrame
    quarantine: DataFrame


def parse_documents(df: DataFrame, text: str, schema: T.StructType, required: str | Sequence[str]) -> DataFrame:
    """Adds `document` and `reason`: NULL for a usable document, else why it is not.

    `required` names the field, or the fields in the order they are looked at, that must be there.
    """
    tolerant = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    document = F.from_json(text, tolerant, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # Taken out of a one-element array, the document is parsed once per row; as a plain column it
    # would be parsed again in every filter that the optimizer moves below the projection.
    parsed = df.withColumn("document", F.explode_outer(F.array(document)))
    reason = F.when(F.col("document").isNull() | F.col(f"document.{CORRUPT}").isNotNull(), "malformed")
    for path in [required] if isinstance(required, str) else required:
        reason = reason.when(F.col(f"document.{path}").isNull(), f"missing {path}")
    return parsed.withColumn("reason", reason).withColumn("document", F.col("document").dropFields(CORRUPT))


def check_documents(df: DataFrame, text: str, schema: T.StructType, required: str | Sequence[str]) -> Checked:
    """Split documents into usable ones and a quarantine that keeps text and reason."""
    parsed = parse_documents(df, text, schema, required)
    return Checked(
        parsed.where("reason IS NULL").drop("reason"),
        parsed.where("reason IS NOT NULL").drop("document"),
    )


# --- tables -------------------------------------------------------------------------------


def generation_intervals(documents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per interval of the parsed documents, with its place in the document as `_place`."""
    placed = documents.select(*keys, F.posexplode("document.data").alias("_place", "_interval"))
    return placed.select(*keys, "_place", "_interval.*").withColumnRenamed("from", "_from")


def share_series(
    documents: DataFrame, keys: Sequence[str] = (), fuel: str = "wind", need_mix: bool = True, place: bool = False
) -> DataFrame:
    """`datetime, wind_perc`: intervals without a start are skipped, a missing fuel is NULL.

    Intervals without a mix are skipped by the nightly reader (`need_mix`); the training reader
    keeps them as NULL. With `place` the position in the document stays as `_place`.
    """
    wanted = F.length("_from") > 0
    if need_mix:
        wanted &= F.size("generationmix") > 0
    intervals = generation_intervals(documents, keys).where(wanted)
    return nan_to_null(
        intervals.select(
            *keys,
            *(["_place"] if place else []),
            parse_utc(F.col("_from")).alias("datetime"),
            fuel_share(F.col("generationmix"), fuel).alias(f"{fuel}_perc"),
        )
    )


def megawatt_series(documents: DataFrame, keys: Sequence[str] = (), fuel: str = "wind") -> DataFrame:
    """`datetime, wind_mw`, only intervals for which an output is known. Start stays as text."""
    output = f"{fuel}_mw"
    intervals = generation_intervals(documents, keys)
    return intervals.select(
        *keys, F.col("_from").alias("datetime"), fuel_megawatts(F.col("generationmix"), fuel).alias(output)
    ).where(F.col(output).isNotNull())


def weather_series(
    documents: DataFrame,
    keys: Sequence[str] = (),
    variables: Sequence[str] = ("temperature_2m", "wind_speed_10m"),
) -> DataFrame:
    """`datetime` and the hourly variables of the parsed weather documents."""
    rows = columns_to_rows(documents, "document.hourly", ["time", *variables], keys)
    return nan_to_null(
        rows.withColumnRenamed("time", "datetime").withColumn("datetime", parse_utc(F.col("datetime")))
    )


def history_of_share(
    df: DataFrame, text: str, order: Sequence[str], keys: Sequence[str] = (), need_mix: bool = True
) -> DataFrame:
    """Raw generation documents to a series with one row per timestamp.

    The first reading is kept: by `order` of the documents, then by place in the document.
    """
    if not order:
        raise ValueError("the order in which documents came has to be named")
    good = check_documents(df, text, GENERATION_DOCUMENT, "data").good
    named = [*keys, *(c for c in order if c not in keys)]
    series = share_series(good, named, need_mix=need_mix, place=True)
    return keep_first(series, [*keys, "datetime"], [*order, "_place"]).select(
        *keys, "datetime", "wind_perc"
    )


def filled_weather(df: DataFrame, text: str, keys: Sequence[str] = (), until=None, **options) -> DataFrame:
    """Raw weather documents of one source to a series without gaps in its variables."""
    good = check_documents(df, text, WEATHER_DOCUMENT, WEATHER_REQUIRED).good
    series = weather_series(good, keys)
    filled = fill_gaps(series, keys, ["datetime"], ["temperature_2m", "wind_speed_10m"], **options)
    return filled if until is None else until_end_of_day(filled, "datetime", until)
