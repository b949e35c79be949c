"""Tables of month parts whose versions are published together by one small write.

Data files are written below a version of their own and never changed. What a reader sees is said by
a manifest: which versions hold which month of which table. A publication writes the data first and
the manifest last, as one file; until then nothing of it is visible, afterwards all of it is. So no
reader meets a half-replaced month, a failure at any point leaves the state before, and rows are not
staged, read and written again. The manifest has two slots that are written in turn: one of them is
whole at any time.

A table may have filters of its keys beside its parts: blocks of 256 bits, rows of an ordinary table,
looked up by a join. They tell of most keys that they are not stored, so that a batch is compared with
the months of its possible repeats only. A month of many parts is merged into one by the next
publication that touches it, so the number of its files stays bounded however many batches come.

One writer at a time; readers are not counted. A `Store` sees what was published when it was first
asked, and what it publishes itself; `refresh` makes it look again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.operators.dedupe import keep_last_of
from gridcast.operators.merge import override
from gridcast.schemas import struct
from gridcast.sources.tables import PARTITIONS, with_months

#: Parts of a month beyond which the next publication merges them.
MAX_PARTS = 8
#: Publications whose tokens are remembered.
MAX_TOKENS = 1000
#: Keys per block of a filter: 256 bits and six hashes, about one key in two hundred is taken for stored.
BLOCK_KEYS = 25
WORDS, PROBES = 4, 6

Month = tuple[int, int]

_MANIFEST = struct(
    {
        "number": T.LongType(),
        "kind": T.StringType(),
        "name": T.StringType(),
        "year": T.IntegerType(),
        "month": T.IntegerType(),
        "version": T.StringType(),
        "rows": T.LongType(),
        "blocks": T.LongType(),
    }
)
_PART, _TOKEN = "part", "token"


@dataclass(frozen=True)
class Part:
    """Rows of one month of a table under one version; tables without a time have the month (0, 0)."""

    name: str
    year: int
    month: int
    version: str
    rows: int
    blocks: int


@dataclass(frozen=True)
class Change:
    """Rows for a table: in place of the months in `replace` ("all": the whole table), beside the rest.

    With `keys` a filter of them is written.
    """

    name: str
    rows: DataFrame
    ts: str | None = None
    order: Sequence[str] = ()
    keys: Sequence[str] = ()
    replace: Iterable[Month] | str = ()


class Store:
    """All tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: tuple[int, list[Part], list[str]] | None = None

    # --- what is published -----------------------------------------------------------------

    def refresh(self) -> None:
        self._known = None

    def _manifest(self) -> tuple[int, list[Part], list[str]]:
        if self._known is None:
            self._known = self._newest()
        return self._known

    def _newest(self) -> tuple[int, list[Part], list[str]]:
        """Number, parts and tokens (oldest first) of the newest whole manifest."""
        newest = (0, [], [])
        for slot in (0, 1):
            try:
                rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/slot={slot}").collect()
            except (AnalysisException, PySparkException):  # not there yet, or being written
                continue
            if rows and rows[0]["number"] > newest[0]:
                parts = [Part(*(r[c] for c in ("name", "year", "month", "version", "rows", "blocks"))) for r in rows if r["kind"] == _PART]
                tokens = [r["version"] for r in sorted((r for r in rows if r["kind"] == _TOKEN), key=lambda r: r["rows"])]
                newest = (rows[0]["number"], parts, tokens)
        return newest

    def parts(self, name: str, months: Iterable[Month] | None = None) -> list[Part]:
        wanted = None if months is None else set(months)
        return [p for p in self._manifest()[1] if p.name == name and (wanted is None or (p.year, p.month) in wanted)]

    def has(self, token: str) -> bool:
        """Whether a publication of this token is there already."""
        return token in self._manifest()[2]

    def rows(self, name: str) -> int:
        """Rows of a table, from the manifest alone."""
        return sum(p.rows for p in self.parts(name))

    def read(self, name: str, months: Iterable[Month] | None = None) -> DataFrame | None:
        """A table, or some months of it; None if nothing is stored of them."""
        return self._rows(self.parts(name, months))

    def _rows(self, parts: Sequence[Part]) -> DataFrame | None:
        if not parts:
            return None
        paths = [f"{self._data(p.name)}/version={p.version}/year={p.year}/month={p.month}" for p in parts]
        reader = self.spark.read.option("basePath", self._data(parts[0].name)).option("mergeSchema", True)
        return reader.parquet(*paths).drop("version", *PARTITIONS)

    def _data(self, name: str) -> str:
        return f"{self.root}/data/{name}"

    def _filters(self, name: str) -> str:
        return f"{self.root}/filters/{name}"

    # --- publication -----------------------------------------------------------------------

    def publish(self, token: str, *changes: Change) -> None:
        """Write the rows of all changes, then make them visible together. A token is published once."""
        number, parts, tokens = self._manifest()
        if token in tokens:
            return
        for change in changes:
            replaced = change.replace
            written = self._write(change)
            if replaced == "all":
                parts = [p for p in parts if p.name != change.name]
            else:
                gone = set(replaced)
                parts = [p for p in parts if p.name != change.name or (p.year, p.month) not in gone]
            parts = [*parts, *written]
        tokens = [*tokens, token][-MAX_TOKENS:]
        self._switch(number + 1, parts, tokens)
        self._known = (number + 1, parts, tokens)

    def _switch(self, number: int, parts: Sequence[Part], tokens: Sequence[str]) -> None:
        """Make the parts of this number the published ones, by one file."""
        rows = [(number, _PART, p.name, p.year, p.month, p.version, p.rows, p.blocks) for p in parts]
        rows += [(number, _TOKEN, None, None, None, t, i, None) for i, t in enumerate(tokens)]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)  # one file: there or not there
        path = f"{self.root}/manifest/slot={number % 2}"
        manifest.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)

    def _write(self, change: Change) -> list[Part]:
        version = f"v{uuid.uuid4().hex}"
        path = f"{self._data(change.name)}/version={version}"
        if change.ts:
            rows = with_months(change.rows.where(F.col(change.ts).isNotNull()), change.ts)
        else:
            rows = change.rows.withColumns({c: F.lit(0) for c in PARTITIONS})
        placed = [*PARTITIONS, *[c for c in change.order if c != change.ts], *([change.ts] if change.ts else [])]
        rows = rows.repartitionByRange(*placed).sortWithinPartitions(*placed) if len(placed) > 2 else rows
        rows.write.partitionBy(*PARTITIONS).parquet(path)
        try:
            written = self.spark.read.parquet(path)
        except AnalysisException:  # no row, so no file
            return []
        counts = {(r["year"], r["month"]): r["count"] for r in written.groupBy(*PARTITIONS).count().collect()}
        blocks = {m: 0 for m in counts}
        if change.keys:
            blocks = {m: -(-n // BLOCK_KEYS) for m, n in counts.items()}
            self._write_filter(change, version, written, blocks)
        return [Part(change.name, *m, version, n, blocks[m]) for m, n in counts.items()]

    # --- filters ---------------------------------------------------------------------------

    def _write_filter(self, change: Change, version: str, written: DataFrame, blocks: dict[Month, int]) -> None:
        sizes = self._sizes([Part(change.name, *m, version, 0, n) for m, n in blocks.items()])
        probed = written.join(F.broadcast(sizes), list(PARTITIONS))  # one row per month
        probed = probed.withColumn("block", _block(change.keys, F.col("blocks")))
        words = [F.bit_or(_word(change.keys, w)).alias(f"w{w}") for w in range(WORDS)]
        filters = probed.groupBy("version", *PARTITIONS, "block").agg(*words)
        filters.write.mode("append").partitionBy("version", *PARTITIONS).parquet(self._filters(change.name))

    def _sizes(self, parts: Sequence[Part]) -> DataFrame:
        rows = [(p.version, p.year, p.month, p.blocks) for p in parts]
        return self.spark.createDataFrame(rows, "version string, year int, month int, blocks long")

    def possible(self, name: str, batch: DataFrame, keys: Sequence[str], ts: str | None = None) -> DataFrame | None:
        """Keys of the batch, with year and month, that the filters do not rule out; None: all are, unlooked."""
        parts = [p for p in self.parts(name, _months(batch, ts) if ts else None) if p.blocks]
        if not parts:
            return None
        own = with_months(batch, ts) if ts else batch.withColumns({c: F.lit(0) for c in PARTITIONS})
        own = own.select(*keys, *PARTITIONS).distinct()
        asked = own.join(F.broadcast(self._sizes(parts)), list(PARTITIONS))  # MAX_PARTS rows per month and some
        asked = asked.withColumn("block", _block(keys, F.col("blocks")))
        paths = [f"{self._filters(name)}/version={p.version}/year={p.year}/month={p.month}" for p in parts]
        filters = self.spark.read.option("basePath", self._filters(name)).parquet(*paths)
        met = asked.join(filters, ["version", *PARTITIONS, "block"])
        held = F.lit(True)
        for w in range(WORDS):
            held &= F.col(f"w{w}").bitwiseAND(_word(keys, w)) == _word(keys, w)
        return met.where(held).select(*keys, *PARTITIONS).distinct()

    def unseen(self, name: str, batch: DataFrame, keys: Sequence[str], ts: str | None = None) -> DataFrame:
        """Rows of the batch whose key is not stored. Months without a possible repeat are not read."""
        possible = self.possible(name, batch, keys, ts)
        if possible is None:
            return batch
        months = [tuple(r) for r in possible.select(*PARTITIONS).distinct().collect()]
        stored = self.read(name, months) if months else None
        if stored is None:
            return batch
        stored = stored.select(*keys).join(possible.select(*keys), list(keys), "left_semi").distinct()
        return batch.join(stored, list(keys), "left_anti")

    # --- ways to change a table ------------------------------------------------------------

    def laid_over(self, name: str, new: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str] = ()) -> Change:
        """One row per key: a new row wins over the stored one, then the last in `order`."""
        merged = keep_last_of([new], keys, order)
        months = _months(new, ts)
        stored = self.read(name, months)
        rows = merged if stored is None else override(stored, merged, keys)
        return Change(name, rows, ts, keys, replace=months)

    def appended(
        self, name: str, new: DataFrame, keys: Sequence[str], ts: str | None = None, among: DataFrame | None = None
    ) -> Change:
        """New rows beside the stored ones; months of too many parts become one part with them.

        `among` are rows whose months include those of `new`, where they are easier to come by.
        """
        counts: dict[Month, int] = {}
        for p in self.parts(name):
            counts[p.year, p.month] = counts.get((p.year, p.month), 0) + 1
        months = set(_months(new if among is None else among, ts)) if ts else {(0, 0)}
        full = [m for m, n in counts.items() if n >= MAX_PARTS and m in months]
        stored = self.read(name, full) if full else None
        rows = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
        return Change(name, rows, ts, keys if ts else (), keys, replace=full)


def _months(df: DataFrame, ts: str) -> list[Month]:
    rows = with_months(df.where(F.col(ts).isNotNull()), ts).select(*PARTITIONS).distinct()
    return [tuple(r) for r in rows.collect()]


def _block(keys: Sequence[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), blocks)


def _word(keys: Sequence[str], word: int) -> Column:
    """The bits that a key sets in one of the words of its block."""
    digest = F.xxhash64(*keys, F.lit("bits"))
    out = F.lit(0).cast("long")
    for probe in range(PROBES):
        bit = F.shiftright(digest, 8 * probe).bitwiseAND(F.lit(64 * WORDS - 1))
        here = F.shiftright(bit, 6) == word
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
        out = out.bitwiseOR(F.when(here, mask).otherwise(F.lit(0).cast("long")))
    return out
