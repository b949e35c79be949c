"""Expressions and small helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import materialize, scratch_path

__all__ = ["folded", "lookup", "partitions_for", "materialize", "scratch_path", "uniform", "WORD"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def folded(text: str | Column) -> Column:
    """Text with null as empty and A-Z, only those, in lower case."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def uniform(*columns: str | Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone (52 bits of an MD5)."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def partitions_for(df: DataFrame, rows: int, per_partition: int) -> int:
    """Shuffle partitions that hold about `per_partition` rows, at least as many as the session sets."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-rows // per_partition))


#: Keys that may count as heavy (each holds more than this share of the rows), and rows below which none does.
HEAVY_KEYS = 1000
HEAVY_ROWS = 100_000


def lookup(
    rows: DataFrame,
    found: DataFrame,
    key: str,
    how: str = "inner",
    total: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """`rows` joined with the one row of `found` for their `key`, also where few keys hold most rows.

    Heavy keys are counted first, but for tables too small to have one. There are at most HEAVY_KEYS
    of them, so their rows of `found` are broadcast and the rows of such a key stay where they are;
    all others meet by shuffle. A caller that knows them gives the number of rows (`total`, or more)
    and the rows per key (`counted`: key, count).
    """
    total = rows.count() if total is None else total
    if total <= HEAVY_ROWS:
        return rows.join(found, key, how)
    limit = max(HEAVY_ROWS, total // HEAVY_KEYS)
    counts = rows.groupBy(key).count() if counted is None else counted
    heavy = counts.where(F.col("count") > limit).select(key).collect()
    if not heavy:
        return rows.join(found, key, how)
    spark = rows.sparkSession
    keys = F.broadcast(spark.createDataFrame(heavy, rows.select(key).schema).withColumn("_heavy", F.lit(True)))
    marked, known = rows.join(keys, key, "left"), found.join(keys, key).drop("_heavy")
    light = marked.where(F.col("_heavy").isNull()).drop("_heavy").join(found, key, how)
    return light.unionByName(marked.where("_heavy").drop("_heavy").join(F.broadcast(known), key, how))
