"""Order-dependent work on rows that Spark keeps in no order.

Two physical strategies stand behind every function here:

* `series`: one window partition per key. One hash shuffle and no extra pass, but a whole
  series ends up in one task, so it is taken only after the largest series was measured.
* `ordered`: rows are range partitioned over (keys, order), numbered, and cut into chunks of
  equal row count. No key, however hot, makes a chunk larger than the others.

Rows that are equal in the given order follow a hash of their content in both, so the strategy, and
with it the size of the input, never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridcast.operators.columns import content_hash, spare
from gridcast.session import materialize

MAX_GROUP_ROWS = 1_000_000
CHUNK_ROWS = 500_000
#: Chunks up to which their starts, one row each, are sent to all tasks.
SENT_CHUNKS = 100_000

# monotonically_increasing_id: partition number in the upper bits, position in the lower 33.
_POSITION_BITS = 33

# Positions of rows that stand before and after all rows of a chunk.
_BEFORE_ALL, _AFTER_ALL = -1, (1 << 63) - 1


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a gap-free position column over a total order, and how many there are."""

    df: DataFrame
    total: int


def ordered_rows(
    df: DataFrame, order: Sequence[str], out: str = "row", tie: str | None = None, unique: bool = False
) -> OrderedRows:
    """Number all rows 0, 1, 2, … in ascending `order` without a single-partition sort.

    Rows equal in `order` follow the column `tie`, or else a hash of their content: it makes the
    numbering deterministic and lets the range partitioner split a timestamp that very many rows share.
    With `unique` the caller states that no rows are equal in it, and nothing is hashed. Only one row
    per partition (its size) reaches the driver.
    """
    spark = df.sparkSession
    place, part_, start = spare([*df.columns, out], "_place", "_part", "_start")
    tied, order = _tied(df, order, tie, unique)
    placed = materialize(
        tied.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*(f"`{c}`" for c in df.columns))
        .withColumn(place, F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright(place, _POSITION_BITS)
    sizes = placed.groupBy(part.alias(part_)).count().collect()

    offsets, total = [], 0
    for part_number, size in sorted(sizes):
        offsets.append((part_number, total))
        total += size
    starts = spark.createDataFrame(offsets, f"`{part_}` LONG, `{start}` LONG")

    position = F.col(place).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    numbered = (
        placed.withColumn(part_, part)
        .join(F.broadcast(starts), part_)  # one row per partition
        .withColumn(out, F.col(start) + position)
        .drop(part_, place, start)
    )
    return OrderedRows(numbered, total)


def _tied(df: DataFrame, order: Sequence[str], tie: str | None, unique: bool) -> tuple[DataFrame, list[str]]:
    """`df` and an order that leaves no rows equal; a hash column is added only where it is needed."""
    if unique or tie:
        return df, [*order, *([tie] if tie else [])]
    (name,) = spare(df.columns, "_tie")
    return df.withColumn(name, content_hash(df)), [*order, name]


def ordered_index(df: DataFrame, order: Sequence[str], out: str = "row", **options) -> DataFrame:
    """`df` with its 0-based position in ascending `order` as column `out`; options as in `ordered_rows`."""
    return ordered_rows(df, order, out, **options).df


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key group: a column-pruned count with map-side combine."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def pick_strategy(
    df: DataFrame, keys: Sequence[str], strategy: str, max_group_rows: int = MAX_GROUP_ROWS
) -> str:
    """Resolve `auto` by measuring the largest series."""
    if strategy == "auto":
        return "series" if largest_group(df, keys) <= max_group_rows else "ordered"
    if strategy not in ("series", "ordered"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return strategy


def with_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    strategy: str = "auto",
    chunk_rows: int = CHUNK_ROWS,
    max_group_rows: int = MAX_GROUP_ROWS,
    tie: str | None = None,
    unique: bool = False,
    row: str | None = None,
) -> DataFrame:
    """Add window columns that look at no more than `reach` earlier rows of the same series.

    `add` receives the rows and an ordered window without a frame. In the ordered strategy the last `reach` rows of every chunk are copied into the next one, so each
    row finds its predecessors in its own chunk; the copies are dropped afterwards.

    `tie` and `unique` are those of `ordered_rows`. `row` names a column that numbers the rows of all
    series in this order already: the ordered strategy then neither sorts nor writes them again.
    """
    if pick_strategy(df, keys, strategy, max_group_rows) == "series":
        tied, order = _tied(df, order, tie, unique)
        added = add(tied, Window.partitionBy(*keys).orderBy(*order))
        return added.drop(*(c for c in tied.columns if c not in df.columns))
    if chunk_rows < reach:
        raise ValueError(f"chunk_rows={chunk_rows} is smaller than reach={reach}")

    number, chunk_ = spare(df.columns, "_row", "_chunk")
    if row is None:
        df = ordered_index(df, [*keys, *order], number, tie=tie, unique=unique)
    else:
        df = df.withColumn(number, F.col(row))
    chunk = F.expr(f"`{number}` DIV {chunk_rows}")
    read_by_next = F.col(number) % chunk_rows >= chunk_rows - reach
    chunks = F.when(read_by_next, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = df.withColumn(chunk_, F.explode(chunks))
    added = add(rows, Window.partitionBy(*keys, chunk_).orderBy(number))
    return added.where(F.col(chunk_) == chunk).drop(number, chunk_)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    forward: Mapping[str, str] | None = None,
    backward: Mapping[str, str] | None = None,
    strategy: str = "auto",
    chunk_rows: int = CHUNK_ROWS,
    max_group_rows: int = MAX_GROUP_ROWS,
    tie: str | None = None,
    unique: bool = False,
    counted: tuple[str, Column] | None = None,
) -> DataFrame:
    """Carry the nearest non-NULL value of a column along the order of a series.

    Both mappings go from a new column to the column it is taken from. `forward` looks from each
    row (itself included) towards the start, `backward` towards the end. Both run as growing
    frames, the backward one over the reversed order: a frame that shrinks from the current row
    to the end would be recomputed for every row.

    `tie` and `unique` are those of `ordered_rows`. `counted` is a new column and a condition: in the
    ordered strategy the column numbers the rows of all series that meet it, 0, 1, 2, … in this order,
    from the numbers of such rows per chunk, without another sort of the whole.
    """
    forward, backward = dict(forward or {}), dict(backward or {})
    if pick_strategy(df, keys, strategy, max_group_rows) == "series":
        tied, order = _tied(df, order, tie, unique)
        carried = _carried(tied, keys, order, forward, backward)
        return carried.drop(*(c for c in tied.columns if c not in df.columns))

    new = [*forward, *backward, *([counted[0]] if counted else [])]
    number, chunk, start = spare([*df.columns, *new], "_row", "_chunk", "_start")
    indexed = ordered_rows(df, [*keys, *order], number, tie, unique)
    rows = indexed.df.withColumn(chunk, F.expr(f"`{number}` DIV {chunk_rows}"))
    starts = None
    if counted:
        sizes = rows.groupBy(chunk).agg(F.count_if(counted[1]).alias(start))
        before = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
        starts = sizes.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    # What each chunk hands on: its last (first) value. One row per chunk and series from here.
    edges = rows.groupBy(*keys, chunk).agg(
        *(_edge(F.max_by, column, out, number) for out, column in forward.items()),
        *(_edge(F.min_by, column, out, number) for out, column in backward.items()),
    )
    # It enters the neighbouring chunks as a row before their first or after their last one.
    ends = ((forward, _BEFORE_ALL, F.asc(chunk)), (backward, _AFTER_ALL, F.desc(chunk)))
    for names, place, toward in ends:
        if names:
            passed = Window.partitionBy(*keys).orderBy(toward)
            earlier = passed.rowsBetween(Window.unboundedPreceding, -1)
            handed = edges.select(
                *keys,
                chunk,
                F.lit(place).alias(number),
                *(F.last(out, True).over(earlier).alias(column) for out, column in names.items()),
            )
            rows = rows.unionByName(handed, allowMissingColumns=True)
    if counted:  # first: its partitioning by chunk alone serves the windows per series as well
        few = indexed.total // chunk_rows < SENT_CHUNKS
        within = Window.partitionBy(chunk).orderBy(*keys, number).rowsBetween(Window.unboundedPreceding, 0)
        real = F.coalesce(counted[1], F.lit(False)) & (F.col(number) > _BEFORE_ALL) & (F.col(number) < _AFTER_ALL)
        rows = rows.withColumn(counted[0], F.sum(real.cast("long")).over(within))
        rows = rows.join(F.broadcast(starts) if few else starts, chunk)
        rows = rows.withColumn(counted[0], F.when(real, F.col(counted[0]) - 1 + F.col(start)))
    carried = _carried(rows, [chunk, *keys], [number], forward, backward)
    real = (F.col(number) > _BEFORE_ALL) & (F.col(number) < _AFTER_ALL)
    return carried.where(real).select(*(f"`{c}`" for c in df.columns), *new)


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    column: str,
    upto: str,
    after: str,
    chunk_rows: int = CHUNK_ROWS,
    tie: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add the sum of `column` over all rows up to each one, itself included, and over all rows after it.

    `upto` and `after` name the new columns; as in Spark, NULLs add nothing and a sum of no values is
    NULL. Every chunk is summed once; within it, both sums run as growing frames, the one after a row over
    the reversed order. `tie` and `unique` are those of `ordered_rows`.
    """
    number, chunk, before, behind = spare([*df.columns, upto, after], "_row", "_chunk", "_before", "_behind")
    indexed = ordered_rows(df, order, number, tie, unique)
    rows = indexed.df.withColumn(chunk, F.expr(f"`{number}` DIV {chunk_rows}"))
    first, summed = Window.unboundedPreceding, F.sum(F.col(f"`{column}`"))
    sums = rows.groupBy(chunk).agg(summed.alias(before))  # one row per chunk
    sums = sums.select(
        chunk,
        F.sum(before).over(Window.orderBy(chunk).rowsBetween(first, -1)).alias(before),
        F.sum(before).over(Window.orderBy(F.desc(chunk)).rowsBetween(first, -1)).alias(behind),
    )
    few = indexed.total // chunk_rows < SENT_CHUNKS
    within = Window.partitionBy(chunk)
    rows = rows.withColumns(
        {
            after: summed.over(within.orderBy(F.desc(number)).rowsBetween(first, -1)),
            upto: summed.over(within.orderBy(number).rowsBetween(first, 0)),
        }
    ).join(F.broadcast(sums) if few else sums, chunk)
    joined = {
        out: F.coalesce(F.col(out) + F.col(others), F.col(out), F.col(others)).alias(out)
        for out, others in ((upto, before), (after, behind))
    }
    return rows.select(*(f"`{c}`" for c in df.columns), *joined.values())


def _carried(df, keys, order, forward, backward) -> DataFrame:
    start = Window.unboundedPreceding
    # The ascending sort comes last: a later window over the same order can reuse it.
    if backward:
        back = Window.partitionBy(*keys).orderBy(*map(F.desc, order)).rowsBetween(start, 0)
        df = df.withColumns({out: F.last(column, True).over(back) for out, column in backward.items()})
    if forward:
        ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(start, 0)
        df = df.withColumns({out: F.last(column, True).over(ahead) for out, column in forward.items()})
    return df


def _edge(pick, column: str, out: str, row: str) -> Column:
    # The order of an absent value is NULL, which min_by and max_by skip.
    return pick(column, F.when(F.col(column).isNotNull(), F.col(row))).alias(out)


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    **options,
) -> DataFrame:
    """Fill NULLs forward, then what is left at the start of a series backward."""
    ahead = dict(zip(columns, spare(df.columns, *(f"_ahead_{c}" for c in columns)), strict=True))
    back = dict(zip(columns, spare(df.columns, *(f"_back_{c}" for c in columns)), strict=True))
    filled = carry(df, keys, order, {v: k for k, v in ahead.items()}, {v: k for k, v in back.items()}, **options)
    return filled.select(
        *(F.coalesce(ahead[c], back[c]).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns)
    )
