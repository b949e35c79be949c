"""The streaming jobs over files that land in a folder; they must equal their batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.plans.history import read_history
from gridcast.session import scratch_path
from gridcast.streaming.history import append_unique, read_stream, stream_upsert
from queries.composites import HISTORY, READINGS, SLOT, batches, slots
from queries.inputs import events
from queries.registry import query


@query("stream_upsert", HISTORY)
def stream_upsert_batches(spark, sf_dir):
    root = scratch_path(spark, "stream")
    for part in batches(spark, sf_dir):
        part.write.mode("append").parquet(f"{root}/landed")
        stream = read_stream(spark, f"{root}/landed", part.schema)
        stream_upsert(stream, f"{root}/history", f"{root}/state", SLOT, order=["event_id"]).awaitTermination()
    return read_history(spark, f"{root}/history")


@query("stream_dedupe", f"WITH {READINGS} SELECT DISTINCT event_type, datetime FROM readings")
def stream_dedupe(spark, sf_dir):
    root = scratch_path(spark, "stream")
    readings = slots(events(spark, sf_dir))
    # Six files in no order of time, one of them per batch.
    readings.repartition(6, F.xxhash64("event_id")).write.parquet(f"{root}/landed")
    stream = read_stream(spark, f"{root}/landed", readings.schema, files_per_batch=1)
    append_unique(stream, f"{root}/unique", f"{root}/state", SLOT).awaitTermination()
    return read_history(spark, f"{root}/unique").select(*SLOT)
