"""One row per key.

`min_by` / `max_by` over the whole row combine on the map side, so a key that holds a third of
all rows still sends one row per input partition through the shuffle. A `row_number` filter
would sort all of that key's rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators.columns import content_hash


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Per key the row that comes first in `order`."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Per key the row that comes last in `order`."""
    return _keep(df, keys, order, F.max_by)


def _keep(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    # Rows that `order` leaves equal follow a hash of their content, so that reruns agree.
    place = F.struct(*order, content_hash(df, rest))
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), place).alias("_kept"))
    return kept.select(*(c if c in keys else F.col("_kept").getField(c).alias(c) for c in df.columns))


def keep_last_of(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union of `parts` with one row per key: a later part wins, then the last in `order`."""
    stacked = None
    for precedence, part in enumerate(parts):
        part = part.withColumn("_precedence", F.lit(precedence))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return keep_last(stacked, keys, ["_precedence", *order]).drop("_precedence")
