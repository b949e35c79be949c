"""The rolling history and the interval feed as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridcast.operators.dedupe import keep_first
from gridcast.plans.history import ROWS, upsert_table
from gridcast.sources.store import Store


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they land in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_upsert(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("datetime",),
    ts: str = "datetime",
    order: Sequence[str] = (),
) -> StreamingQuery:
    """Lay every micro-batch over the history at `path`; a later batch wins, then `order`.

    Only the months of a batch are rewritten, and readers see all of a batch or nothing of it. A batch
    that is replayed after a failure finds itself published or not, so that it counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch.sparkSession, path, batch, keys, ts, order, token=f"{checkpoint}#{batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
        .trigger(availableNow=True)
        .start()
    )


def append_unique(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    ts: str = "datetime",
    order: Sequence[str] = (),
) -> StreamingQuery:
    """Append readings whose key the table at `path` lacks, the first one (by `order`) of each key.

    A key is compared with everything stored, however late it comes: filters of the stored keys say
    which months could hold it, and only those are read. Batches add parts to their months, which are
    merged when they are many. A replayed batch is known by its token. Rows without a time have no
    key and are left out.
    """
    if ts not in keys:
        raise ValueError(f"{ts} has to be one of the keys {list(keys)}")

    def write(batch: DataFrame, batch_id: int) -> None:
        store, token = Store(batch.sparkSession, path), f"{checkpoint}#{batch_id}"
        if store.has(token):
            return
        first = keep_first(batch.where(F.col(ts).isNotNull()), keys, order)
        fresh = store.unseen(ROWS, first, keys, ts)
        store.publish(token, store.appended(ROWS, fresh, keys, ts, among=batch))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
