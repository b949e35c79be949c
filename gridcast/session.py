"""Session set-up and the shared folder that intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Local masters without a configured folder get one temporary folder per application.
_local_folders: dict[str, str] = {}


def build_session(app_name: str = "gridcast", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every gridcast plan assumes; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC instants everywhere; calendar parts are read in the session zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Refuse a session whose zone would shift hours, days and holidays."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}; calendar features need UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local master may run without that setting; a cluster has to name a folder, since a
    driver's temporary directory is lost with its machine and invisible to the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="gridcast-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/gridcast/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Needed where two passes must see the same values of a computed row position, also after an
    executor is lost: range partitioning samples its boundaries anew on every run. A parquet
    table, unlike a row checkpoint, lets each later pass read only its columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
