"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most `distance` bits apart agree in some
segment up to distance // segments bits, so every fingerprint enters one table per segment under its
exact segment, and looks there for all values in a small Hamming ball around its own. Whatever it
meets is verified by the full distance.

Exact copies share a fingerprint and enter once. Where a table entry gathers many near copies, not
all their pairs are put out: a task keeps what is linked already in a union-find forest, compares a
fingerprint only with those not yet in its component, and puts out the forest, at most one link per
fingerprint. Components are then found by alternating star contractions, all as joins and sums.

Segment values are counted before the tables are filled. A value that holds very many fingerprints
is cut into blocks of entries and pieces of the rows that look there; every block meets every piece
in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import lookup, materialize, partitions_for
from gridcast.llm.registry import register, table

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEGMENTS = 3
SEED = 42
BITS = 64
#: Comparisons of one table entry that are made at once as plain pairs; larger entries go by components.
PLAIN_PAIRS = 1 << 14
#: Components of a large entry whose outsiders are remembered.
KEPT_LISTS = 8
#: Entries, and other rows, of one segment value that one task compares; values with more are cut into blocks.
BLOCK = 1 << 16
#: Values that may count as heavy: each holds more than this share of the fingerprints.
HEAVY_VALUES = 1000
#: Probe rows per shuffle partition.
PARTITION_ROWS = 4_000_000
#: Shingles hashed at once.
STRETCH = 1 << 18


# --- Fingerprints ----------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash over word shingles, repeats included; 0 without a word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        starts, ends = [0], [len(joined)]
    else:
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = [0, *(stops[: len(parts) - words] + 1).tolist()]
        ends = stops[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STRETCH):
        pairs = zip(starts[at : at + STRETCH], ends[at : at + STRETCH], strict=True)
        found = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


# --- Links -----------------------------------------------------------------------------------------


def _segments(segments: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def _probes(fp: np.ndarray, segments: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Table keys, fingerprints, and whether they are the tables' own entries (1) or probes (0)."""
    for number, (low, width) in enumerate(_segments(segments)):
        own = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        tag = np.uint64(number << 40)
        yield own | tag, fp, 1
        for flips in range(1, radius + 1):
            for bits in combinations(range(width), flips):
                yield (own ^ np.uint64(sum(1 << b for b in bits))) | tag, fp, 0


class _Forest:
    """Union-find over the fingerprints that have a link in this task; links that join two trees are kept."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        parent = self.parent
        top = a
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(a, a)) != top:
            parent[a], a = top, up
        return top

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.parent.setdefault(min(x, y), min(x, y))
            self.links.append((a, b))


def _link_plain(own: np.ndarray, others: np.ndarray, distance: int, forest: _Forest) -> None:
    """Compare paired arrays."""
    near = np.flatnonzero((np.bitwise_count(own ^ others) <= distance) & (own != others))
    for a, b in zip(own[near].tolist(), others[near].tolist(), strict=True):
        forest.join(a, b)


def _link_large(own: np.ndarray, others: np.ndarray, distance: int, forest: _Forest) -> None:
    """Compare each of `own` with those of `others` that are not in its component yet."""
    outside: dict[int, np.ndarray] = {}  # component -> what is known not to be in it, at most
    for a in own.tolist():
        root = forest.root(a)
        rest = outside.get(root, others)
        near = np.bitwise_count(rest ^ np.uint64(a)) <= distance
        for b in rest[near].tolist():
            forest.join(a, b)
        outside.pop(root, None)
        outside[forest.root(a)] = rest[~near]
        if len(outside) > KEPT_LISTS:  # the shortest lists belong to the components that grow
            outside.pop(max(outside, key=lambda r: len(outside[r])))


def _link_group(keys: np.ndarray, fps: np.ndarray, entries: np.ndarray, distance: int, forest: _Forest) -> None:
    """All rows of some whole keys, sorted by key: entries against entries and probes of their key."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    held = np.add.reduceat(entries.astype(np.int64), starts)
    work = held * (ends - starts)
    plain = (held > 0) & (ends - starts > 1) & (work <= PLAIN_PAIRS)
    size = (ends - starts)[plain]
    if len(size):
        # Spread every entry over the rows of its key.
        rows = np.repeat(starts[plain] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        key_of = np.repeat(np.arange(len(size)), size)
        mine = entries[rows]
        left, group = fps[rows[mine]], key_of[mine]
        first, count = starts[plain][group], size[group]
        for at in range(0, len(left), 1 << 16):
            n = count[at : at + (1 << 16)]
            offset = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            other = fps[np.repeat(first[at : at + (1 << 16)], n) + offset]
            _link_plain(np.repeat(left[at : at + (1 << 16)], n), other, distance, forest)
    for g in np.flatnonzero(work > PLAIN_PAIRS):
        part = slice(starts[g], ends[g])
        _link_large(fps[part][entries[part]], fps[part], distance, forest)


def _blocks(values: np.ndarray, counts: np.ndarray, segments: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table keys that heavy values fill or probe, ascending, with their blocks of entries and pieces of other rows.

    `counts` says how many fingerprints have each of the heavy `values` (segment << 40 | own value).
    """
    held, asked = dict(zip(values.tolist(), counts.tolist(), strict=True)), {}
    for value, n in held.items():
        tag, own = value >> 40 << 40, value & ((1 << 40) - 1)
        width = _segments(segments)[value >> 40][1]
        for flips in range(radius + 1):
            for bits in combinations(range(width), flips):
                key = (own ^ sum(1 << b for b in bits)) | tag
                asked[key] = asked.get(key, 0) + n
    keys = sorted(asked)
    return (
        np.array(keys, np.uint64),
        np.array([-(-held.get(k, 1) // BLOCK) for k in keys], np.int64),
        np.array([-(-asked[k] // BLOCK) for k in keys], np.int64),
    )


def _dealt(
    keys: np.ndarray, fps: np.ndarray, entry: int, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Keys, slots, fingerprints and whether they are entries. Rows of a heavy key meet as blocks x pieces.

    An entry goes to all pieces of its block, any row to all blocks of its piece, so that each entry
    meets each row of its key in exactly one slot. Keys that are not heavy have the one slot 0.
    """
    names, blocks, pieces = heavy
    if not len(names):
        yield keys, np.zeros(len(keys), np.int64), fps, bool(entry)
        return
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    hot = names[at] == keys
    yield keys[~hot], np.zeros(int((~hot).sum()), np.int64), fps[~hot], bool(entry)
    keys, fps, at = keys[hot], fps[hot], at[hot]
    spread = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    b, p = blocks[at], pieces[at]
    block, piece = (spread % b.astype(np.uint64)).astype(np.int64), (spread // b.astype(np.uint64) % p.astype(np.uint64)).astype(np.int64)

    def repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(times)), times)
        return rows, np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)

    if entry:
        rows, other = repeated(p)
        yield keys[rows], block[rows] * p[rows] + other, fps[rows], True
    rows, other = repeated(b)
    yield keys[rows], other * p[rows] + piece[rows], fps[rows], False


def links(distinct: DataFrame, rows: int, distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within `distance` bits do.

    `distinct` has each fingerprint once as `fp`; `rows` is their number. Segment values are counted
    first: those that hold more than a block (and more than one in HEAVY_VALUES of all) are compared
    in blocks, by many tasks.
    """
    radius = distance // segments
    limit = max(BLOCK, rows // HEAVY_VALUES)
    heavy = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if rows > limit:
        values = F.array(*(
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(number << 40))
            for number, (low, width) in enumerate(_segments(segments))
        ))
        counted = distinct.select(F.explode(values).alias("value")).groupBy("value").count().where(F.col("count") > limit)
        found = counted.collect()  # at most segments * HEAVY_VALUES rows
        if found:
            heavy = _blocks(np.array([r["value"] for r in found]), np.array([r["count"] for r in found]), segments, radius)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for keys, fps, entry in _probes(fp, segments, radius):
                for key, slot, own, is_entry in _dealt(keys, fps, entry, heavy):
                    columns = [key.view(np.int64), slot, own.view(np.int64), np.full(len(own), is_entry)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "slot", "fp", "entry"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = _Forest(), []  # held: parts of the last key and slot, joined once they are complete

        def settle(parts: list[list[np.ndarray]]) -> None:
            group, fps, entries = (np.concatenate(x) for x in zip(*parts, strict=True))
            _link_group(group, fps, entries, distance, forest)

        ends = None  # key and slot that the last batch ended with, and their number in this task
        for batch in batches:
            key, slot, fps = (batch.column(i).to_numpy() for i in range(3))
            entries = batch.column(3).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            number = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])))).astype(np.int64)
            if ends is not None:
                number += ends[1] + (ends[0] != (key[0], slot[0]))
            ends = ((key[-1], slot[-1]), number[-1])
            part, whole = [number, fps.view(np.uint64), entries], np.searchsorted(number, number[-1])
            if whole:
                settle([*held, [x[:whole] for x in part]])
                held = []
            elif held and held[-1][0][-1] != number[0]:
                settle(held)
                held = []
            held.append([x[whole:] for x in part])
        if held:
            settle(held)
        found = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    per_row = segments + sum(len(list(combinations(range(w), f))) for _, w in _segments(segments) for f in range(1, radius + 1))
    parts = partitions_for(distinct, rows * per_row, PARTITION_ROWS)
    dealt = distinct.select("fp").mapInArrow(probe, "key long, slot long, fp long, entry boolean").repartition(parts, "key", "slot")
    return dealt.sortWithinPartitions("key", "slot").mapInArrow(link, "a long, b long")


# --- Components ------------------------------------------------------------------------------------


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the least node of the component.

    Large-star and small-star steps in turn: every node passes on the least node it knows, first to
    its greater neighbours, then to its smaller ones. Each step is a minimum per node, combined on
    the map side, and a join, in which the links of a node with very many stay where they are; no list
    of neighbours is ever gathered. Ends when a round changes nothing.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, label)
    size, before = pairs.count(), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = lookup(both, least, "a", total=2 * size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = lookup(large, small_least, "a", total=2 * size)
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        pairs = materialize(small.where("a != b").distinct(), label)
        size, total = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == (size, total):
            break
        before = (size, total)
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fp (signed 64-bit), component_id (least doc_id reachable by links).

    A null text counts as empty and has fingerprint 0, linked like any other. Texts of fewer than
    `words` words are one shingle. Rows with equal fingerprints are linked; repeated rows are too. A
    null id is no component's name unless all ids of the component are null. No rows give none.
    """
    marked = materialize(fingerprints(docs, words, doc_id, text), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = materialize(links(distinct, distinct.count(), distance), "links")
    roots = components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return lookup(marked, labels, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of `docs`, with their columns, of one document per group: the one with the least id."""
    keep = near_groups(docs, words, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept_id"]), "left_semi")


@register("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
