"""Replicate the events along time and time the join and window strategies on long series.

usage: python bench_scale.py FACTOR [SKEW]

FACTOR copies of the events follow each other, so that a series grows longer and not only wider.
With SKEW all events get the same type: one series holds everything.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from gridcast import build_session
from gridcast.operators.asof import nearest_join, pick_join_strategy
from gridcast.operators.ordered import fill_gaps, ordered_index, with_windows
from gridcast.operators.windows import lag_columns, with_rolling
from gridcast.schemas import LAG_ROWS, ROLLING_ROWS
from gridcast.session import materialize

KEYS = ["event_type"]


def replicated(spark, sf_dir: str, factor: int, skew: bool):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return copies.repartition(16).select(
        (F.lit("all") if skew else F.col("event_type")).alias("event_type"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(days=F.col("copy") * 30)).alias("datetime"),
        F.col("value"),
        (F.col("copy").cast("long") * 100_000_000 + F.col("event_id")).alias("event_id"),
    )


def main() -> None:
    factor = int(sys.argv[1])
    skew = len(sys.argv) > 2
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "gridcast-scale",
        master=f"local[{cpus}]",
        spark_sql_shuffle_partitions=4 * int(cpus),
        spark_driver_memory="16g",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    right = materialize(replicated(spark, sf_dir, factor, skew), "scale")
    left = right.where("event_id % 2 = 0").select("event_type", "datetime", F.col("value").alias("speed"))
    other = right.select("event_type", "datetime", "event_id", (F.col("value") * 2).alias("share"))
    seconds = {"rows": right.count(), "picked": pick_join_strategy(left, other, keys=KEYS)}

    def windows(df, w):
        return with_rolling(df.withColumns(lag_columns(w, "value", "v", LAG_ROWS)), w, "value", "v", ROLLING_ROWS)

    holes = right.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    order = ["datetime", "event_id"]
    runs = {"index": lambda: ordered_index(right, order)}
    for strategy in ("series", "bucket", "ordered"):
        runs[f"asof_{strategy}"] = lambda s=strategy: nearest_join(
            left, other, keys=KEYS, right_order=["event_id"], values=["share"], strategy=s
        )
    for strategy in ("series", "ordered"):
        runs[f"windows_{strategy}"] = lambda s=strategy: with_windows(right, KEYS, order, 95, windows, strategy=s)
        runs[f"fill_{strategy}"] = lambda s=strategy: fill_gaps(holes, KEYS, order, ["value"], strategy=s)
    for name, build in runs.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"factor": factor, "skew": skew, **seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
