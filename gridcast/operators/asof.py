"""Nearest-timestamp join within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators.columns import content_hash, spare
from gridcast.operators.ordered import CHUNK_ROWS, MAX_GROUP_ROWS, carry

HALF_HOUR = timedelta(minutes=30)
BUCKET_TOLERANCES = 48


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    on: str = "datetime",
    keys: Sequence[str] = (),
    tolerance: timedelta = HALF_HOUR,
    right_order: Sequence[str] = (),
    values: Sequence[str] | None = None,
    strategy: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    unique: bool = False,
    place: str | None = None,
    row: str | None = None,
) -> DataFrame:
    """Every left row with `values` of the right row nearest in time, NULL if none is near.

    The tolerance is inclusive. Equal distances take the earlier row. Among right rows with the
    same timestamp the last one (by `right_order`, then by a hash of the row) counts when they lie
    at or before the left row, the first one when they lie after it.

    Both sides are laid into one ordered sequence in which each left row reads the last right
    row before it and the first one after it, so the work is linear in the rows: no pair of
    rows is ever formed. The strategies are those of `pick_join_strategy`.

    With `unique` the caller states that no two left rows, nor two right rows by `right_order`, have
    the same keys and time: nothing is hashed. A name in `place` keeps a column by which left rows of
    one time follow each other, so that later windows ordered by (on, place) find the rows sorted; one
    in `row` numbers the left rows of all series in that order, in the ordered strategy only.
    """
    keys = list(keys)
    if values is None:
        values = [c for c in right.columns if c not in (on, *keys)]
    clashes = set(values) & set(left.columns)
    if clashes:
        raise ValueError(f"columns on both sides: {sorted(clashes)}")
    if strategy == "auto":
        strategy = pick_join_strategy(left, right, on, keys, tolerance, max_group_rows)

    names = left.columns
    taken = {*names, *right.columns}
    own_place, entry, before, after, matched, bucket = spare(
        taken, place or "_place", "_entry", "_before", "_after", "_match", "_bucket"
    )
    if place in taken or row in taken:
        raise ValueError(f"{place!r} or {row!r} is a column already")
    # Rows of one time: right before left, those by their order, all of them last by a hash.
    kinds = {f.name: f.dataType for f in right.schema}
    last = lambda df: [] if unique else [content_hash(df).alias("hash")]
    ranks = lambda of: [of(c).alias(f"order{i}") for i, c in enumerate(right_order)]
    entries = right.where(F.col(on).isNotNull()).select(
        *keys,
        on,
        F.struct(F.lit(0).alias("side"), *ranks(F.col), *last(right)).alias(own_place),
        F.struct(F.col(on).alias("at"), *values).alias(entry),
    )
    nothing = ranks(lambda c: F.lit(None).cast(kinds[c]))
    asking = left.withColumn(own_place, F.struct(F.lit(1).alias("side"), *nothing, *last(left)))
    groups = keys
    if strategy == "bucket":
        width = tolerance * BUCKET_TOLERANCES
        groups = [*keys, bucket]
        asking = asking.withColumn(bucket, _bucket(F.col(on), width))
        entries = entries.withColumn(bucket, F.explode(_buckets_in_reach(F.col(on), width, tolerance)))

    asks = F.col(own_place).getField("side") == 1
    carried = carry(
        asking.unionByName(entries, allowMissingColumns=True),
        groups,
        [on],
        forward={before: entry},
        backward={after: entry},
        strategy="ordered" if strategy == "ordered" else "series",
        chunk_rows=chunk_rows,
        tie=own_place,
        counted=(row, asks) if row and strategy == "ordered" else None,
    ).where(asks)

    limit = F.lit(_as_micros(tolerance))
    behind = _micros(F.col(on)) - _micros(F.col(before).getField("at"))
    ahead = _micros(F.col(after).getField("at")) - _micros(F.col(on))
    nearer_after = (ahead <= limit) & (F.col(before).isNull() | (ahead < behind))
    match = F.when(nearer_after, F.col(after)).when(behind <= limit, F.col(before))
    kept = [*([own_place] if place else []), *([row] if row and strategy == "ordered" else [])]
    return carried.withColumn(matched, match).select(
        *(f"`{c}`" for c in names), *kept, *(F.col(matched).getField(c).alias(c) for c in values)
    )


def pick_join_strategy(
    left: DataFrame,
    right: DataFrame,
    on: str = "datetime",
    keys: Sequence[str] = (),
    tolerance: timedelta = HALF_HOUR,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> str:
    """Measure both sides, from their key and time columns only, and choose

    * `series`: one group per key, whose partitioning later per-series windows can reuse;
    * `bucket`: one group per key and stretch of time, right rows within the tolerance of an
      edge being copied across it, when a series is too long for one group;
    * `ordered`: equal chunks of a range-partitioned order, when even one stretch is too full.
    """
    columns = [*keys, _bucket(F.col(on), tolerance * BUCKET_TOLERANCES).alias("_bucket")]
    both = left.select(*columns).unionAll(right.select(*columns))
    stretches = both.groupBy(*keys, "_bucket").count()
    series = stretches.groupBy(*keys).agg(F.sum("count").alias("rows"), F.max("count").alias("full"))
    largest = series.agg(F.max("rows").alias("rows"), F.max("full").alias("full")).first()
    if (largest["rows"] or 0) <= max_group_rows:
        return "series"
    return "bucket" if largest["full"] <= max_group_rows else "ordered"


def _as_micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _bucket(ts: Column, width: timedelta) -> Column:
    return F.floor(_micros(ts) / F.lit(_as_micros(width)))


def _buckets_in_reach(ts: Column, width: timedelta, tolerance: timedelta) -> Column:
    reach = F.expr(f"INTERVAL {_as_micros(tolerance) / 1e6:f} SECOND")
    return F.sequence(_bucket(ts - reach, width), _bucket(ts + reach, width))
