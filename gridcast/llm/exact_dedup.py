"""Exact de-duplication of a batch against immutable snapshots.

A sealed snapshot holds one entry per distinct text (SHA-256 of the text, rows, largest id), dealt
into buckets, and for every bucket a static binary-fuse filter over its digests. A new batch is
first grouped by itself; its distinct digests are screened by the filters. A negative is certainly
new. A positive is joined with the exact entries of its bucket. Wherever rows are to be merged,
their bytes are compared, so that a digest alone never decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import HEAVY_KEYS, folded, lookup, materialize
from gridcast.llm.registry import register, table

#: Digests of one filter; the number of buckets follows from it and the rows of the snapshot.
BUCKET_KEYS = 50_000
#: Copies of one text whose bytes are checked in one task; texts with more are dealt into parts.
COPIES = 10_000
_MAX_SEEDS = 64


# --- Binary-fuse filter: three slots in neighbouring segments, 8-bit fingerprints -----------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser; unsigned arithmetic wraps."""
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(multiplier)
    return h ^ (h >> np.uint64(29))


def _shape(n: int) -> tuple[int, int]:
    """Slots of a segment (a power of two) and number of segments for n keys."""
    length = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    capacity = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
    return length, max(1, -(-capacity // length) - 2)


def _slots(h: np.ndarray, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key as rows, and its fingerprint."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    inner = np.stack([h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(9)) & mask])
    slots = inner + (first + np.arange(3, dtype=np.uint64)[:, None]) * np.uint64(length)
    return slots.astype(np.int64), (h ^ (h >> np.uint64(40))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, bytes]:
    """Seed and table of a filter that answers true for each of the distinct uint64 `keys`.

    Keys are peeled in rounds: every slot that holds a single key takes that key out. Then the
    rounds are undone in reverse, which sets the slot of each key last of its three.
    """
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(_MAX_SEEDS):
        slots, prints = _slots(_mixed(keys, seed), length, segments)
        degree = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        index = np.arange(len(keys))
        for row in slots:
            np.bitwise_xor.at(held, row, index)
        rounds, frontier = [], np.flatnonzero(degree == 1)
        while len(frontier):
            key, where = np.unique(held[frontier], return_index=True)
            rounds.append((key, frontier[where]))
            touched = slots[:, key]
            np.subtract.at(degree, touched.ravel(), 1)
            np.bitwise_xor.at(held, touched.ravel(), np.tile(key, 3))
            touched = np.unique(touched)
            frontier = touched[degree[touched] == 1]
        if sum(len(key) for key, _ in rounds) == len(keys):
            cells = np.zeros(size, np.uint8)
            for key, own in reversed(rounds):
                a, b, c = cells[slots[:, key]]  # the key's own slot is still zero
                cells[own] = prints[key] ^ a ^ b ^ c
            return seed, cells.tobytes()
    raise ValueError("no seed peels these keys; are they distinct?")


def in_filter(keys: np.ndarray, n: int, seed: int, cells: bytes) -> np.ndarray:
    """Which keys the filter over `n` keys holds; false positives about 1 in 256."""
    length, segments = _shape(n)
    slots, prints = _slots(_mixed(keys, seed), length, segments)
    a, b, c = np.frombuffer(cells, np.uint8)[slots]
    return (a ^ b ^ c) == prints


# --- Snapshots -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """Immutable: entries (sha, n, keep_id, bucket) and filters (bucket, keys, seed, cells)."""

    entries: DataFrame
    filters: DataFrame
    buckets: int


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and sha (hex) of the folded text, one row per document."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.sha2(folded(text), 256).alias("sha"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("key", F.xxhash64("sha")).withColumn("bucket", F.pmod("key", F.lit(buckets)))


def seal(rows: DataFrame) -> Snapshot:
    """A snapshot of `digests` rows: entries and one filter per bucket, written to the shared folder."""
    grouped = materialize(_groups(rows), "snapshot-groups")
    buckets = max(1, -(-grouped.count() // BUCKET_KEYS))
    entries = _bucketed(grouped, buckets)

    def build(bucket: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(bucket["key"].to_numpy().astype(np.uint64))
        seed, cells = build_filter(keys)
        return pd.DataFrame({"bucket": [bucket["bucket"].iloc[0]], "keys": [len(keys)], "seed": [seed], "cells": [cells]})

    filters = (
        entries.select("bucket", "key")
        .groupBy("bucket")
        .applyInPandas(build, "bucket long, keys long, seed long, cells binary")
    )
    return Snapshot(entries.drop("key"), materialize(filters, "snapshot-filters"), buckets)


def screened(batch: DataFrame, snapshot: Snapshot, rows: int | None = None) -> DataFrame:
    """Grouped batch with `maybe`: whether the snapshot's filter of the bucket holds the digest.

    Buckets follow the snapshot's size. Where the batch (`rows` of it at most) is the larger side, the
    digests of a bucket are dealt into parts of about BUCKET_KEYS, and its filter is sent to each part.
    """
    rows = batch.count() if rows is None else rows
    parts = max(1, -(-rows // (snapshot.buckets * BUCKET_KEYS)))

    def probe(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        hits = np.zeros(len(keys), bool)
        if len(own) and len(keys):
            one = own.iloc[0]
            hits = in_filter(keys["key"].to_numpy().astype(np.uint64), int(one["keys"]), int(one["seed"]), one["cells"])
        return keys.drop(columns=["key", "part"]).assign(maybe=hits)

    dealt = _bucketed(batch, snapshot.buckets).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part")
    return (
        dealt.groupBy("bucket", "part")
        .cogroup(snapshot.filters.select("*", part).groupBy("bucket", "part"))
        .applyInPandas(probe, "sha string, n long, keep_id long, bucket long, maybe boolean")
    )


def merged_groups(batch_rows: DataFrame, snapshot: Snapshot, rows: int | None = None) -> DataFrame:
    """(sha, n, keep_id) over snapshot and batch: only positives meet the entries, those of their bucket."""
    batch = materialize(screened(_groups(batch_rows), snapshot, rows), "screened")
    maybe, entries = batch.where("maybe").drop("maybe"), snapshot.entries
    found = maybe.select("bucket", "sha", F.col("n").alias("more"), F.col("keep_id").alias("new_id")).join(
        entries, ["bucket", "sha"]
    )
    n, keep = (F.col("n") + F.col("more")).alias("n"), F.greatest("keep_id", "new_id").alias("keep_id")
    found = materialize(found.select("bucket", "sha", n, keep), "found")
    known = found.select("bucket", "sha")
    fresh = batch.where(~F.col("maybe")).drop("maybe").unionByName(maybe.join(known, ["bucket", "sha"], "left_anti"))
    rest = entries.join(known, ["bucket", "sha"], "left_anti")
    return found.unionByName(fresh).unionByName(rest).drop("bucket")


def _differing(docs: DataFrame, groups: DataFrame, text: str, rows: int) -> DataFrame:
    """Digests whose rows are not byte for byte the same (a SHA-256 collision).

    Least and greatest text of a digest are combined on the map side. A digest with very many copies
    is dealt into parts, as many as its count asks for, so that its copies never meet in one task; at
    most HEAVY_KEYS digests hold that large a share of the rows, so their parts are broadcast.
    """
    limit = max(COPIES, rows // HEAVY_KEYS)
    parts = F.when(F.col("n") > limit, F.ceil(F.col("n") / COPIES)).otherwise(1).cast("long").alias("parts")
    repeated = groups.where("n > 1").select("sha", parts)
    many = F.broadcast(repeated.where("parts > 1"))
    texts = docs.select("doc_id", folded(text).alias("body")).withColumn("sha", F.sha2("body", 256))
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).alias("salt")
    texts = texts.join(many, "sha", "left").select("sha", salt, "body")
    salts = repeated.select("sha", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    ends = (
        texts.join(salts.hint("merge"), ["sha", "salt"], "left_semi")  # repeated digests grow with the table
        .groupBy("sha", "salt")
        .agg(F.min("body").alias("low"), F.max("body").alias("high"))
    )
    spread = ends.groupBy("sha").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return spread.where("low != high").select("sha")


def exact_groups(docs: DataFrame, arrived: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document of `docs` and, after them, `arrived`: doc_id, keep_id, group_size, kept, text_sha256.

    `docs` is sealed as a snapshot, `arrived` is the batch that is screened against it. Equal are
    texts that agree after lower-casing A-Z; the largest id stays. A null text counts as empty. A
    null id loses to any other; a group of null ids only has a null keep_id and keeps its rows.
    Rows that repeat an id with the same text are one document and share its fate. Ids are whole
    numbers. Texts are read whole whatever their length. Other columns are ignored. No rows give no rows.
    """
    if arrived is None:
        arrived = docs.limit(0)
    old = materialize(digests(docs, doc_id, text), "digests")
    new = materialize(digests(arrived, doc_id, text), "digests")
    more = new.count()
    total = old.count() + more
    groups = materialize(merged_groups(new, seal(old), more), "groups")

    both = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).unionByName(
        arrived.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    )
    differing = materialize(_differing(both, groups, "text", total), "differing")
    counted = groups.select("sha", F.col("n").alias("count"))
    rows = lookup(old.unionByName(new), groups, "sha", total=total, counted=counted)
    if not differing.isEmpty():  # same digest, other bytes: those digests are grouped by their bytes
        exact = both.select("doc_id", folded("text").alias("body")).withColumn("sha", F.sha2("body", 256))
        exact = exact.join(differing, "sha", "left_semi")
        sizes = exact.groupBy("sha", "body").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
        rows = rows.join(differing, "sha", "left_anti").unionByName(exact.join(sizes, ["sha", "body"]).drop("body"))
    return rows.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    keep = exact_groups(*arrivals(docs)).where("kept").select("text_sha256", "doc_id").distinct()
    digest = docs.withColumn("_sha", F.sha2(folded("text"), 256))
    same = (digest["_sha"] == keep["text_sha256"]) & digest["doc_id"].eqNullSafe(keep["doc_id"])
    return digest.join(keep, same, "left_semi").drop("_sha")


def arrivals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table as an older and a newer delivery, by the parity of a hash of the id: every row is in one."""
    older = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs.where(older), docs.where(~older)


@register(
    "op1_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
      FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY body)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(*arrivals(table(spark, sf_dir, "documents")))
