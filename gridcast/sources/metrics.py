"""Metrics documents and training logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.schemas import LEARNING_CURVE, TRAINING_TIME
from gridcast.sources.tables import read_csv


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document per row of a metrics frame."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_document(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Metrics documents; absent keys are NULL, an absent or unreadable file gives no rows.

    `multi_line` reads one (indented) document per file, otherwise each line is a document.
    """
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED")
    try:
        return reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cv_document(folds: DataFrame) -> DataFrame:
    """Per-fold rows `fold, rmse, mape` as one document of means, deviations and fold lists."""

    def in_fold_order(metric: str):
        pairs = F.array_sort(F.collect_list(F.struct("fold", metric)))
        return F.transform(pairs, lambda p: p[metric])

    return folds.agg(
        F.avg("mape").alias("mean_mape_perc"),
        F.stddev_pop("mape").alias("std_mape_perc"),
        F.avg("rmse").alias("mean_rmse_perc"),
        F.stddev_pop("rmse").alias("std_rmse_perc"),
        F.struct(in_fold_order("mape").alias("mape_perc"), in_fold_order("rmse").alias("rmse_perc")).alias("folds"),
    )


def training_log(spark: SparkSession, learn_path: str, test_path: str) -> DataFrame:
    """Learning and test curve side by side: `iter, learn_rmse, test_rmse`."""
    learn = read_csv(spark, learn_path, LEARNING_CURVE, sep="\t").withColumnRenamed("rmse", "learn_rmse")
    test = read_csv(spark, test_path, LEARNING_CURVE, sep="\t").withColumnRenamed("rmse", "test_rmse")
    return learn.join(test, "iter", "full")


def training_time(spark: SparkSession, path: str) -> DataFrame:
    """The remaining-time log: `iter, passed, remaining` in milliseconds."""
    return read_csv(spark, path, TRAINING_TIME, sep="\t")


def time_report(log: DataFrame) -> DataFrame:
    """One row: iterations, time they took, time per iteration, and by how much the first estimate was off.

    The first estimate is the time that had passed and was thought to remain at the first iteration.
    """
    last, first = F.max_by("passed", "iter"), F.min_by(F.col("passed") + F.col("remaining"), "iter")
    return log.agg(
        (F.max("iter") - F.min("iter") + 1).cast("long").alias("iterations"),
        last.alias("passed"),
        (last / (F.max("iter") - F.min("iter") + 1)).alias("per_iteration"),
        (first - last).alias("estimate_off"),
    ).where("iterations IS NOT NULL")


def best_iteration(log: DataFrame, metric: str = "test_rmse") -> DataFrame:
    """`best_iter, best_rmse`: the earliest iteration with the lowest error."""
    return log.agg(
        F.min_by("iter", F.when(F.col(metric).isNotNull(), F.struct(metric, "iter"))).alias("best_iter"),
        F.min(metric).alias("best_rmse"),
    )
