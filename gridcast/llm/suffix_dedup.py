"""Removal of long repeated byte strings with a run-length compressed index.

Every string of `LENGTH` bytes has an anchor: the least hashed gram inside it, the first of equals.
Equal strings have their anchors at the same place, so only strings with the same anchor need to be
compared. A document is cut into stretches of starts that share an anchor; the bytes that their
strings cover are the stretch's context.

1. Contexts are digested in one scan and counted by (anchor, digest). Where one comes twice, all its
   strings are repeated, and no byte of it has to move. The digests that decide this are 128 bits of
   BLAKE2, so that no two different texts can be found, or built, that share one.
2. What else shares an anchor is fetched from the documents, one copy per distinct context, and dealt
   into shards by anchor. A shard builds the Burrows-Wheeler transform of its contexts, compresses it
   to runs and keeps suffix positions and match lengths at the run ends only: inside a run a match
   is that of the suffix one place before it, less one. So the contexts are streamed once and the
   longest match of each start with any other follows from the sampled run ends. Starts with a match
   of `LENGTH` or more are marked.
3. An anchor with very many distinct contexts (endless repetition of few words) would make a shard
   of unbounded size. Its starts are dealt by such digests of their strings instead, which spreads
   over all shards; starts whose string comes again in the same batch are marked there at once, and
   one of them speaks for all, so that repetition does not multiply what is moved.
4. Marked starts are joined to their documents and the covered bytes cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import materialize, partitions_for
from gridcast.llm.registry import register, table

LENGTH = 400
#: Bytes of a hashed gram.
GRAM = 32
#: Starts of a document that are worked on at once; anchors' places take this many bits.
STRETCH_BITS = 20
#: Bytes of contexts per shard, and distinct contexts of an anchor up to which the index takes it.
SHARD_BYTES = 1_000_000
INDEXED_CONTEXTS = 1000
_MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


# --- Digests of substrings and anchors --------------------------------------------------------------


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random odd number per byte."""
    n = (1 << STRETCH_BITS) + 2 * LENGTH
    series = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, np.uint64(base))
        steps[0] = 1
        series.append(np.multiply.accumulate(steps))
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return series[0], series[1], values


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Digests:
    """Digests of all substrings of up to a stretch of bytes, to pick anchors by; equal strings have equal digests anywhere.

    They only bring together what may be equal: anchors with one digest are told apart later.
    """

    def __init__(self, data: np.ndarray):
        self.up, down, values = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start])


def _strong(pieces: Iterator[bytes]) -> np.ndarray:
    """Two halves of 64 bits of the BLAKE2 digest of each piece."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), np.uint64).reshape(-1, 2)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values, from running minima inside blocks of that width."""
    count = len(values) - width + 1
    blocks = np.concatenate((values, np.full(-len(values) % width, np.uint64(_MASK64)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def stretches(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor digest, context digest in two halves, first and last start of each stretch of starts with one anchor.

    Long documents come in parts; a stretch that two parts share comes as two.
    """
    room = 1 << STRETCH_BITS
    for base in range(0, len(data) - LENGTH + 1, room - LENGTH):
        part = data[base : base + room]
        if len(part) < LENGTH:
            break
        digests = Digests(part)
        places = np.arange(len(part) - GRAM + 1)
        grams = digests.of(places, places + GRAM)
        keys = (grams & np.uint64(_MASK64 ^ (room - 1))) | places.astype(np.uint64)
        least = _least(keys, LENGTH - GRAM + 1)[: room - LENGTH]
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], len(least)) - 1
        anchor = (least[first] & np.uint64(room - 1)).astype(np.int64)
        body = part.tobytes()
        spans = zip((anchor - first).tolist(), first.tolist(), (last + LENGTH).tolist(), strict=True)
        context = _strong(b"%d:%b" % (offset, body[a:b]) for offset, a, b in spans)
        yield grams[anchor], context[:, 0], context[:, 1], first + base, last + base


# --- The run-length index ----------------------------------------------------------------------------


def _suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], int]:
    """Suffix array, ranks of all suffixes by their first `depth` symbols for growing depths, and the growth factor."""
    n = len(symbols)
    bits = n.bit_length()
    factor = max(2, min(3, 63 // bits))
    depth, wide = 7, np.concatenate((symbols.astype(np.int64), np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(7):  # nine bits a symbol
        key = key << 9 | wide[k : k + n]
    levels = []
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        levels.append((depth, rank))
        if rank[order[-1]] == n:
            return order, levels, factor
        wide = np.concatenate((rank, np.zeros((factor - 1) * depth, np.int64)))  # 0: past the end
        key = rank.copy()
        for k in range(1, factor):
            key = key << bits | wide[k * depth : k * depth + n]
        depth *= factor


def _common(symbols: np.ndarray, levels: list, factor: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of different suffixes."""
    n, length = len(symbols), np.zeros(len(a), np.int64)
    for depth, rank in reversed([(1, symbols), *levels]):
        for _ in range(6 if depth == 1 else factor - 1):
            x, y = a + length, b + length
            inside = (x < n) & (y < n)
            length += depth * (inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    return length


def long_matches(contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Per byte of the contexts, each followed by a separator: whether a string of `length` that starts there starts elsewhere too."""
    joined = b"".join(contexts)
    ends = np.cumsum(np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1) - 1
    symbols = np.zeros(len(joined) + len(contexts), np.int16)  # 0 separates
    symbols[np.delete(np.arange(len(symbols)), ends)] = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    n = len(symbols)
    suffixes, levels, factor = _suffixes(symbols)
    transform = symbols[suffixes - 1]
    # Run heads, without the first row; around the suffix that has nothing before it runs are cut.
    heads = transform[1:] != transform[:-1]
    heads |= (suffixes[1:] == 0) | (suffixes[:-1] == 0)
    heads = np.flatnonzero(heads) + 1
    above, below = suffixes[heads - 1], suffixes[heads]  # the sampled run ends
    matched = _common(symbols, levels, factor, above, below)
    # Streaming: place + match never falls along the text, and rises at sampled run ends only.
    longest = np.zeros(n, np.int64)
    for own in (below, above):
        reach = np.zeros(n, np.int64)
        reach[own] = matched + own
        np.maximum(longest, np.maximum.accumulate(reach) - np.arange(n), out=longest)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    return (longest >= length) & (left >= length)


# --- Spark -----------------------------------------------------------------------------------------

#: A start of an anchor with very many contexts: digest of its string, document, place, copies of its context.
_HOT = np.dtype([("digest", "u8"), ("check", "u8"), ("doc", "i8"), ("key", "i8"), ("place", "i8"), ("copies", "i8"), ("null", "i1")])
#: Kinds of rows on their way to a shard.
_CONTEXT, _STARTS, _KNOWN = range(3)
_MARKS = "doc_id long, key long, start long, stop long"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (rows with equal id and key have equal texts) and the text as bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), body.cast("binary").alias("body"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "key", "anchor", "context", "check", "first", "last"]
    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        for row, body in enumerate(batch.column("body")):
            for found in stretches(np.frombuffer(body.as_buffer(), np.uint8)):
                n = len(found[0])
                own = [pa.array([ids[row]] * n, pa.int64()), pa.array(np.full(n, keys[row]))]
                yield pa.RecordBatch.from_arrays([*own, *(_signed(np.ascontiguousarray(f)) for f in found)], names)


def _fetch(shards: int):
    """Contexts of documents (body, wanted) as rows for their shards, starts of hot anchors packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "kind", "doc_id", "key", "first", "copies", "body"]
        for batch in batches:
            rows, packed = [], []
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for doc_id, key, body, wanted in zip(ids, keys, batch.column("body"), batch.column("wanted").to_pylist(), strict=True):
                data = memoryview(body.as_buffer())
                for one in wanted:
                    first, stop = one["first"], one["last"] + LENGTH
                    if not one["hot"]:
                        rows.append((one["anchor"] % shards, _CONTEXT, doc_id, key, first, one["copies"], bytes(data[first:stop])))
                        continue
                    part = bytes(data[first:stop])
                    starts = np.arange(len(part) - LENGTH + 1)
                    own = np.zeros(len(starts), _HOT)
                    own["digest"], own["check"] = _strong(part[i : i + LENGTH] for i in range(len(starts))).T
                    own["doc"], own["null"], own["key"] = doc_id or 0, doc_id is None, key
                    own["place"], own["copies"] = starts + first, one["copies"]
                    packed.append(own)
            if packed:
                every, known = _spoken_for(np.concatenate(packed))
                rows += [(key % shards, _KNOWN, doc_id, key, start, stop, None) for doc_id, key, start, stop in known]
                shard = (every["digest"] % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                every, shard = every[order], shard[order]
                cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
                for a, b in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
                    rows.append((int(shard[a]), _STARTS, None, 0, 0, 0, zstandard.compress(_columns(every[a:b]), 1)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    edge = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate(([0], edge + 1))], places[np.append(edge, len(places) - 1)]


def _indexed(rows: list[tuple]) -> list[tuple]:
    """Marks (doc_id, key, start, stop) of one shard's contexts."""
    marks, at = [], 0
    found = long_matches([row[3] for row in rows])
    for doc_id, key, (first, copies), body in rows:
        places = np.flatnonzero(found[at : at + len(body)])
        at += len(body) + 1
        if copies == 1 and len(places):  # contexts that come twice are marked without
            for a, b in zip(*_runs(places), strict=True):
                marks.append((doc_id, key, first + int(a), first + int(b) + LENGTH))
    return marks


def _columns(starts: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(starts[c]).tobytes() for c in _HOT.names)


def _starts(body: bytes) -> np.ndarray:
    n = len(body) // _HOT.itemsize
    out, at = np.empty(n, _HOT), 0
    for name in _HOT.names:
        out[name] = np.frombuffer(body, _HOT[name], n, at)
        at += n * _HOT[name].itemsize
    return out


def _by_digest(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in order of their digests, first of each digest, and for each start whether its string comes again."""
    starts = starts[np.lexsort((starts["check"], starts["digest"]))]
    same = (starts["digest"][1:] == starts["digest"][:-1]) & (starts["check"][1:] == starts["check"][:-1])
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    again = np.repeat(np.add.reduceat(starts["copies"], heads) > 1, np.diff(np.append(heads, len(starts))))
    return starts, heads, again


def _ranges(starts: np.ndarray) -> list[tuple]:
    """Marks of starts, those side by side as one."""
    own = starts[np.lexsort((starts["place"], starts["key"], starts["doc"], starts["null"]))]
    if not len(own):
        return []
    new = own["place"][1:] != own["place"][:-1] + 1
    for name in ("doc", "key", "null"):
        new |= own[name][1:] != own[name][:-1]
    first = np.concatenate(([0], np.flatnonzero(new) + 1))
    last = np.append(first[1:], len(own)) - 1
    return [
        (None if null else doc, key, a, b + LENGTH)
        for null, doc, key, a, b in zip(*(own[c][first].tolist() for c in ("null", "doc", "key", "place")), own["place"][last].tolist(), strict=True)
    ]


def _spoken_for(starts: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """One start per string, and marks of those whose string comes again among them; one that speaks for several has copies above one."""
    starts, heads, again = _by_digest(starts)
    known = _ranges(starts[again & (starts["copies"] == 1)])
    own = starts[heads]
    own["copies"] = np.where(again[heads], np.maximum(own["copies"], 2), own["copies"])
    return own, known


def _counted(packed: list[bytes]) -> list[tuple]:
    """Marks of the starts whose digest comes more than once."""
    starts, _, again = _by_digest(np.concatenate([_starts(zstandard.decompress(p)) for p in packed]))
    return _ranges(starts[again & (starts["copies"] == 1)])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: the index over each shard's contexts, counts over its packed starts."""
    shard, rows, packed, known = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        marks = (_indexed(rows) if rows else []) + (_counted(packed) if packed else []) + known
        if marks:
            columns = [pa.array(c, pa.int64()) for c in zip(*marks, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "start", "stop"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "doc_id", "key", "first", "copies", "body")]
        for own, kind, doc_id, key, first, copies, body in zip(*columns, strict=True):
            if own != shard:
                yield from close()
                shard, rows, packed, known = own, [], [], []
            if kind == _STARTS:
                packed.append(body)
            elif kind == _KNOWN:
                known.append((doc_id, key, first, copies))
            else:
                rows.append((doc_id, key, (first, copies), body))
    yield from close()


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, start, stop): byte ranges of `keyed` documents that repeated strings cover; they may overlap."""
    bodies = keyed(docs, doc_id, text)
    scanned = materialize(
        bodies.mapInArrow(_scan, "doc_id long, key long, anchor long, context long, check long, first long, last long"), "stretches"
    )
    place = F.struct("doc_id", "key", "first", "last")
    kinds = materialize(
        scanned.groupBy("anchor", "context", "check").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("one")), "contexts"
    )
    sure = kinds.where("copies > 1").select("anchor", "context", "check")
    whole = scanned.join(sure, ["anchor", "context", "check"]).select(
        "doc_id", "key", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")
    )

    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_kinds = kinds.join(shared, "anchor").select(
        "one.*", "anchor", "copies", (F.col("n") > INDEXED_CONTEXTS).alias("hot")
    )
    wanted = materialize(
        open_kinds.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "first", "last", "copies", "hot")).alias("wanted")),
        "wanted",
    )
    size = wanted.select(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + LENGTH)))
    shards = partitions_for(docs, size.first()[0] or 0, SHARD_BYTES)
    same = ["doc_id", "key"]
    # Of rows that repeat id and text, one is fetched: they are equal.
    asked = bodies.join(wanted.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "wanted"),
                        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).drop("_d", "_k")
    fetched = asked.mapInArrow(
        _fetch(shards), "shard long, kind long, doc_id long, key long, first long, copies long, body binary"
    )
    marked = fetched.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_mark, _MARKS)
    return whole.unionByName(materialize(marked.select(*same, "start", "stop"), "marked"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for body, ranges in zip(batch.column("body"), batch.column("ranges"), strict=True):
            data = np.frombuffer(body.as_buffer(), np.uint8)
            steps = np.zeros(len(data) + 1, np.int32)
            if ranges.is_valid:
                flat = ranges.values
                np.add.at(steps, flat.field("start").to_numpy(), 1)
                np.add.at(steps, flat.field("stop").to_numpy(), -1)
            gone = np.cumsum(steps[:-1]) > 0
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0)))
            kept.append(data[~gone].tobytes())
        columns = [pa.array(c, pa.int64()) for c in (sizes, removed, spans)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Removed is every byte that lies in a string of `LENGTH` bytes of the input which also starts
    elsewhere, in the same or another document. A null text counts as empty. Rows that repeat an id
    with the same text repeat each other's strings and lose them; null ids are ids like others. Other
    columns are ignored; no rows give none.
    """
    marks = repeated(docs, doc_id, text)
    ranges = marks.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    ranges = ranges.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "ranges")
    bodies = keyed(docs, doc_id, text)
    both = bodies.join(ranges, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return both.select("doc_id", "body", "ranges").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


@register("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
