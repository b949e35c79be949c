"""Removal of repeated word windows by recompression: runs and pairs of symbols get common names.

Every round replaces runs of one symbol, then pairs of a left and a right symbol, by new symbols. The
name of a symbol is a digest of what it stands for, so all tasks of all rounds agree on names without
exchanging a dictionary, and equal substrings get equal symbols but for a few at their ends. With each
symbol goes its reach: the stretch of words that alone decides that the symbol stands there. A symbol
whose reach lies within a window is interior to it, and any equal window has it at the same place.

* Every window takes one interior symbol of the highest round that has one (the least by a hash) as
  its anchor. Windows side by side mostly share an anchor; they form one row of it: the name of the
  anchor with its reach as key, and a digest of 128 bits over all words of the row's windows.
* Rows meet by key. A row whose digest came earlier is a repeat as a whole. A key with one digest
  holds no other repeat. Only where a key has several digests - at the edges of repeats - single
  windows are compared, by digests of 128 bits of their own words.
* What was found is joined to the texts, and covered words go.

Names decide which windows meet, never what is removed: that the 128-bit digests do, whose seed is
drawn anew for every run, so that no text can be built to collide.

Order: by doc_id (null first), of rows with one doc_id by a digest of the text, then by position. Of
equal rows (same id, same text) one keeps its words as any document does, the others lose every word
of their windows. Null texts count as empty. Texts of fewer words than a window stay whole; very long
ones are worked through in overlapping stretches. Columns other than doc_id and text are not read, so
names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.llm.common import materialize
from gridcast.llm.registry import register, table

WINDOW = 20
ROUNDS = 2
#: Words that are worked on together; a longer text is cut into stretches that overlap by a window.
CHUNK_WORDS = 1 << 17
#: Rows of one key in one task. Keys beyond it are found on one of SAMPLE documents and split by digest.
HOT_ROWS = 100_000
SAMPLE = 64
#: Most keys that are split; a key that is not among them holds less than this share of all rows.
HOT_KEYS = 1000

_INDEX_BITS = 20
_INDEX = np.uint64((1 << _INDEX_BITS) - 1)


def _mix(x: np.ndarray, y: np.ndarray | int, seed: int) -> np.ndarray:
    """A 64-bit digest of an ordered pair, element by element."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(29)
    z = z * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(y).astype(np.uint64)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def _word_names(words: list[bytes], seed: int) -> np.ndarray:
    """Two digests of 64 bits per word."""
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    digests = b"".join(xxhash.xxh3_128_digest(w, seed) for w in distinct)
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)[codes]


class _Symbols:
    """A string of symbols with start, end and reach [low, high) of each, in words.

    Barriers stand at both ends and between stretches. Their class is 2: they pair with nothing.
    """

    def __init__(self, names: np.ndarray, barrier: np.ndarray):
        place = np.arange(len(names))
        self.names, self.barrier = names, barrier
        self.start, self.low, self.high = place, place, place + 1

    def interior(self) -> _Symbols:
        return self._taken(~self.barrier, self.low, self.high, self.names)

    def _taken(self, at, low, high, names) -> _Symbols:
        out = object.__new__(_Symbols)
        out.names, out.barrier, out.start, out.low, out.high = names[at], self.barrier[at], self.start[at], low[at], high[at]
        return out

    def runs(self, seed: int) -> _Symbols:
        """Every longest run of one symbol as a symbol; that it ends is known from both neighbours."""
        first = np.flatnonzero(np.append(True, self.names[1:] != self.names[:-1]))
        last = np.append(first[1:], len(self.names)) - 1
        times = last - first + 1
        names = self.names.copy()
        names[first] = np.where(times > 1, _mix(names[first], times, seed), names[first])
        low, high = self.low.copy(), self.high.copy()
        low[first] = self.low[np.maximum(first - 1, 0)]
        high[first] = self.high[np.minimum(last + 1, len(names) - 1)]
        return self._taken(first, low, high, names)

    def pairs(self, seed: int) -> _Symbols:
        """Every left symbol before a right one as one symbol with it; the sides come from a hash of the name."""
        side = (_mix(self.names, 0, seed) >> np.uint64(63)).astype(np.int8)
        side[self.barrier] = 2
        joined = np.append((side[:-1] == 0) & (side[1:] == 1), False)
        kept = ~np.append(False, joined[:-1])
        after, before = np.append(self.names[1:], np.uint64(0)), np.append(self.low[:1], self.low[:-1])
        next_high = np.append(self.high[1:], self.high[-1:])
        names = np.where(joined, _mix(self.names, after, seed + 1), self.names)
        # A left symbol alone is known by its right neighbour, a right one by its left neighbour.
        low = np.where(side == 1, before, self.low)
        high = np.where(side == 0, next_high, self.high)
        return self._taken(kept, low, high, names)


def _blocks(lane: np.ndarray, window: int, seed: int) -> list[np.ndarray]:
    """Digests of all blocks of 1, 2, 4, … words, up to the largest that a window holds."""
    out, size = [lane], 1
    while size * 2 <= window:
        lane = _mix(lane[: max(0, len(lane) - size)], lane[size:], seed + size)
        out.append(lane)
        size *= 2
    return out


def _digest(blocks: list[np.ndarray], at: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Digest of words at … at + length, for lengths below two windows: of four blocks that cover them."""
    level = np.minimum(np.log2(length).astype(np.int64), len(blocks) - 1)
    out = np.zeros(len(at), np.uint64)
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        here, rest = at[own], length[own] - (1 << int(k))
        digest = _mix(blocks[k][here], length[own], seed)
        for j in (1, 2, 3):
            digest = _mix(digest, blocks[k][here + rest * j // 3], seed + j)
        out[own] = digest
    return out


def _least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least of values[left:right], pair by pair; all ranges hold something."""
    level = np.floor(np.log2(np.maximum(right - left, 1))).astype(np.int64)
    out = np.empty(len(left), np.uint64)
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = level == k
        out[own] = np.minimum(values[left[own]], values[right[own] - (1 << k)])
        values = np.minimum(values, np.append(values[1 << k :], np.full(min(1 << k, len(values)), values[-1:])))
    return out


def anchored(names: np.ndarray, barrier: np.ndarray, window: int, rounds: int, seed: int) -> dict[str, np.ndarray]:
    """Rows of neighbouring windows with one anchor: first window, number of windows, key, digest in two halves."""
    place = np.flatnonzero(~barrier)
    wall = np.append(np.flatnonzero(barrier), len(barrier))
    inside = place + window <= wall[np.searchsorted(wall, place)]
    windows = place[inside]
    anchor = np.full(len(windows), -1)
    name, low, high = np.zeros(len(windows), np.uint64), windows.copy(), windows.copy()
    symbols = _Symbols(names[:, 0], barrier)
    levels = [symbols]
    for k in range(rounds):
        symbols = symbols.runs(seed + 16 * k + 3).pairs(seed + 16 * k + 7)
        levels.append(symbols)
    for k in range(rounds, -1, -1):
        own = levels[k].interior()
        todo = np.flatnonzero(anchor < 0)
        left = np.searchsorted(own.low, windows[todo])
        right = np.searchsorted(own.high, windows[todo] + window, "right")
        todo, left, right = (x[right > left] for x in (todo, left, right))
        if not len(todo):
            continue
        ranks = (_mix(own.names, k, seed + 11) & ~_INDEX) | np.arange(len(own.names), dtype=np.uint64)
        chosen = (_least_between(ranks, left, right) & _INDEX).astype(np.int64)
        anchor[todo] = k << _INDEX_BITS | chosen
        name[todo], low[todo], high[todo] = own.names[chosen], own.low[chosen], own.high[chosen]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1))[: len(windows)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    at, length = windows[first], window + count - 1
    blocks = [_blocks(names[:, lane], window, seed + 64 * lane) for lane in (0, 1)]
    reach = _digest(blocks[0], low[first], high[first] - low[first], seed + 21)
    a, b = (_digest(blocks[lane], at, length, seed + 17 + 8 * lane) for lane in (0, 1))
    return {"at": at, "n": count, "key": _mix(name[first], reach, seed + 13), "a": a, "b": b}


def _later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows repeat the digest of an earlier row of the same chunk."""
    order = np.lexsort((np.arange(len(a)), b, a))
    same = np.append(False, (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]))[: len(a)]
    out = np.zeros(len(a), bool)
    out[order] = same
    return out


def _merged(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows that follow on each other as one."""
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1]))[: len(row)]
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    return row[first], start[first], total


_FOUND = ["key", "a", "b", "doc_id", "print", "start", "n", "repeat"]


def _rows(batch: pa.RecordBatch, row, start, n, key, a, b) -> pa.RecordBatch:
    """Rows of a chunk for the shuffle: first holders of their digest, and ranges already known as repeats."""
    again = _later(a, b)
    known_row, known_start, known_n = _merged(row[again], start[again], n[again])
    row, start, n = (np.concatenate((x[~again], y)) for x, y in ((row, known_row), (start, known_start), (n, known_n)))
    known = np.zeros(len(known_row), np.uint64)
    place = known_start.astype(np.uint64)
    a, b = np.concatenate((a[~again], place)), np.concatenate((b[~again], known))
    prints = np.asarray(batch.column("print"))
    key = np.concatenate((key[~again], _mix(prints[known_row].astype(np.uint64), place, 1)))
    repeat = np.zeros(len(row), bool)
    repeat[len(row) - len(known) :] = True
    take = pa.array(row)
    columns = [key.view(np.int64), a.view(np.int64), b.view(np.int64), batch.column("doc_id").take(take), prints[row]]
    columns += [start.astype(np.int64), n.astype(np.int64), repeat]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _FOUND)


def _in_order(batch: pa.RecordBatch) -> list[int]:
    """Row numbers by (doc_id, print), null first, one of equal rows only."""
    ids, prints = batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
    first = {}
    for i, own in enumerate(zip(ids, prints, strict=True)):
        first.setdefault(own, i)
    return [first[k] for k in sorted(first, key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1]))]


def _stretches(batch: pa.RecordBatch, window: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Chunks of (row, first word, words); a long text is cut so that each window lies in one stretch."""
    chunk, held = [], 0
    bodies = batch.column("body")
    for row in _in_order(batch):
        words = bodies[row].as_py().split()  # bytes: exactly the ASCII blanks part words
        for at in range(0, max(0, len(words) - window + 1), CHUNK_WORDS):
            part = words[at : at + CHUNK_WORDS + window - 1]
            chunk.append((row, at, part))
            held += len(part)
            if held >= CHUNK_WORDS:
                yield chunk
                chunk, held = [], 0
    if chunk:
        yield chunk


def _anchor_rows(window: int, rounds: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _stretches(batch, window):
                words = [b""]
                rows, offsets, starts = [], [], []
                for row, at, part in chunk:
                    rows.append(row)
                    offsets.append(at)
                    starts.append(len(words))
                    words += part
                    words.append(b"")
                barrier = np.zeros(len(words), bool)
                barrier[[0, *(s - 1 for s in starts[1:]), len(words) - 1]] = True
                names = _word_names(words, seed).copy()
                walls = np.flatnonzero(barrier).astype(np.uint64)  # no two barriers are equal
                names[barrier] = _mix(walls, 0, seed + 5)[:, None]
                found = anchored(names, barrier, window, rounds, seed)
                stretch = np.searchsorted(starts, found["at"], "right") - 1
                start = found["at"] - np.array(starts)[stretch] + np.array(offsets)[stretch]
                yield _rows(batch, np.array(rows)[stretch], start, found["n"], found["key"], found["a"], found["b"])

    return run


def _window_rows(window: int, seed: int):
    """Single windows of the ranges `spans` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for chunk in _requested(batch, spans, window):
                words = [w for *_, part in chunk for w in part]
                sizes = np.array([len(part) for *_, part in chunk])
                first = np.cumsum(sizes) - sizes
                n = sizes - window + 1
                which = np.repeat(np.arange(len(chunk)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                place = first[which] + step
                names = _word_names(words, seed)
                length = np.full(len(place), window)
                halves = [_digest(_blocks(names[:, lane], window, seed + 64 * lane), place, length, seed + 31 + 8 * lane) for lane in (0, 1)]
                row = np.array([row for row, *_ in chunk])[which]
                start = np.array([at for _, at, _ in chunk])[which] + step
                yield _rows(batch, row, start, np.ones(len(row), np.int64), halves[0], *halves)

    return run


def _requested(batch: pa.RecordBatch, spans: pa.Array, window: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    chunk, held = [], 0
    for row in _in_order(batch):
        words = batch.column("body")[row].as_py().split()
        for span in sorted((s["start"], s["n"]) for s in spans[row].as_py()):
            part = words[span[0] : span[0] + span[1] + window - 1]
            chunk.append((row, span[0], part))
            held += len(part)
            if held >= CHUNK_WORDS:
                yield chunk
                chunk, held = [], 0
    if chunk:
        yield chunk


def _kept_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for body, spans, copy in zip(*(batch.column(c) for c in ("body", "spans", "copy")), strict=True):
                words = body.as_py().split()
                change = np.zeros(len(words) + 1, np.int64)
                found = [(s["start"], s["n"]) for s in spans.as_py() or ()]
                if copy.as_py() > 1 and len(words) >= window:
                    found = [(0, len(words) - window + 1)]
                for start, n in found:
                    change[start] += 1
                    change[start + n + window - 1] -= 1
                stays = np.cumsum(change)[:-1] == 0
                left = [w for w, s in zip(words, stays, strict=True) if s] if found else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _split_hot(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """`rows` with `salt`: 0, but for keys of very many rows, whose digests are dealt over several tasks.

    The sample only balances the work; rows of one key and digest meet in any case.
    """
    counts = sample.groupBy("key").agg((F.count(F.lit(1)) * SAMPLE).alias("rows")).where(F.col("rows") > HOT_ROWS)
    hot = counts.orderBy(F.desc("rows"), "key").limit(HOT_KEYS)
    hot = hot.select(F.col("key").alias("_key"), F.ceil(F.col("rows") / HOT_ROWS).alias("_tasks"))
    found = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)
    joined = rows.join(F.broadcast(found), F.col("key") == F.col("_key"), "left")  # HOT_KEYS rows at most
    salt = F.when(F.col("_tasks").isNotNull(), F.pmod("a", F.col("_tasks"))).otherwise(F.lit(0))
    return joined.withColumn("salt", salt).drop("_key")


def repeated(bodies: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Ranges of repeated windows: doc_id, print, start, n, for `bodies` of doc_id, mark, print, body (UTF-8).

    Each range says that windows start … start + n - 1 of the text also start earlier somewhere.
    """
    seed = secrets.randbits(48)
    kind = bodies.schema["doc_id"].dataType.simpleString()
    schema = f"key long, a long, b long, doc_id {kind}, print long, start long, n long, repeat boolean"
    scan = _anchor_rows(window, rounds, seed)
    sample = bodies.where(F.pmod(F.xxhash64("doc_id", "print"), F.lit(SAMPLE)) == 0)
    rows = _split_hot(bodies.mapInArrow(scan, schema), sample.mapInArrow(scan, schema))

    own = F.struct("doc_id", "print", "start")
    same = Window.partitionBy("key", "salt", "a", "b").orderBy("doc_id", "print", "start")
    group = Window.partitionBy("key", "salt")
    differs = lambda half: F.min(half).over(group) != F.max(half).over(group)
    judged = (
        rows.withColumn("first", F.first(own).over(same))
        .withColumn("repeat", F.col("repeat") | (own != F.col("first")))
        # Digests of a split key are spread, so all its rows count as being among others.
        .withColumn("mixed", F.col("_tasks").isNotNull() | differs("a") | differs("b"))
        .where(F.col("repeat") | F.col("mixed"))
        .select("doc_id", "print", "start", "n", "repeat")
    )
    judged = materialize(judged, "anchors")

    spans = judged.where(~F.col("repeat")).groupBy(_mark(), "print").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    windows = _joined(bodies, spans, "inner").mapInArrow(_window_rows(window, seed), schema)
    alike = Window.partitionBy("a", "b").orderBy("doc_id", "print", "start")
    again = windows.withColumn("repeat", F.col("repeat") | (own != F.first(own).over(alike)))
    columns = ["doc_id", "print", "start", "n"]
    return materialize(judged.where("repeat").select(columns).unionByName(again.where("repeat").select(columns)), "repeats")


def _mark():
    """A hash of the id that is never null: with the digest of the text it says which row a range is of."""
    return F.xxhash64("doc_id").alias("mark")


def _joined(bodies: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Texts with the ranges of their row: a text's ranges are bounded by its length."""
    return bodies.join(spans, ["mark", "print"], how)


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept (words left, by one blank)."""
    text = F.coalesce("text", F.lit(""))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    bodies = docs.select("doc_id", _mark(), digest.alias("print"), text.cast("binary").alias("body"))
    found = repeated(bodies, window, rounds)
    spans = found.groupBy(_mark(), "print").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    copy = F.row_number().over(Window.partitionBy("mark", "print").orderBy("print"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = _joined(bodies, spans, "left").withColumn("copy", copy)
    return marked.mapInArrow(_kept_words(window), f"doc_id {kind}, n_words long, n_removed long, kept string")


#: Windows are compared as strings of 20 words; a word holds no blank, so strings are equal when the words are.
SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), numbered AS (
  SELECT doc_id, w, len(w) AS n, unnest(range(1, greatest(len(w) - 18, 1))) AS place FROM words
), windows AS (
  SELECT doc_id, place, array_to_string(list_slice(w, place, place + 19), ' ') AS body FROM numbered
), ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) AS turn FROM windows
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 20)) AS place FROM ranked WHERE turn > 1
), gone AS (
  SELECT doc_id, list(place) AS gone, count(*) AS n_removed FROM covered GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""


@register("op13_substring_dedup", sql=SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
