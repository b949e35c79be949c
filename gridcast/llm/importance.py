"""Importance resampling towards a target distribution, over hashed word n-grams.

Words are found by an Aho-Corasick automaton. Its patterns are words between delimiters, ` word `, and
each carries the CRC-32 and the length of its word as payload: a scan of a text emits payloads, and
the checksum of an n-gram is composed from the payloads of adjacent words and of the blank between
them, without touching the bytes again. The checksum modulo the number of buckets is the feature.

The dictionary holds the commonest words of the whole corpus, counted by Spark, up to a fixed number
of words of a fixed length, so that the automaton has a proven size whatever the corpus. Places of a
text that no pattern covers are words outside the dictionary; their checksums are computed directly,
so the dictionary changes the speed and never a result.

A text is scanned once, into its buckets with counts (no longer than the number of buckets, however
long the text). Bucket counts of both distributions are sums over all rows; log ratios of the two give
a weight per document, and Gumbel noise from a hash of the id turns the best scores into a draw.

Null texts have no words; so do empty ones. Texts longer than a chunk are scanned in pieces that are
cut at delimiters. Equal scores go by the smaller doc_id (null first), then by weight and number of
features, so that repeated rows give one result. Empty tables give no rows, an empty target or source
has all counts at 0. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import materialize
from gridcast.llm.registry import register, table
from gridcast.operators.ordered import ordered_rows

BUCKETS = 10_000
#: Words in the dictionary, and bytes of its longest one.
DICTIONARY_WORDS = 1 << 15
LONGEST = 48
#: Bytes scanned together.
CHUNK_BYTES = 1 << 22
#: Different words that are counted in a task before they are handed on.
HELD_WORDS = 1 << 19


@lru_cache(maxsize=1)
def _folding() -> bytes:
    """Byte by byte: A-Z in lower case, letters, digits and all beyond ASCII as they are, the rest blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Dictionary:
    """Automaton of delimited words with their checksums and lengths as payloads."""

    def __init__(self, words: list[bytes]):
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        if words:
            self.automaton.make_automaton()

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, checksum and length of every word of a folded text that begins and ends with a blank."""
        inside = np.frombuffer(text, np.uint8) != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        crc = np.zeros(len(start), np.uint32)
        length = end - start
        open_ = np.ones(len(start), bool)
        if len(self.crc) and len(start):
            hits = np.fromiter(self.automaton.iter(text.decode("latin-1")), np.dtype([("end", "i8"), ("word", "i8")]))
            place = np.searchsorted(end, hits["end"])  # a pattern ends with the blank after its word
            crc[place] = self.crc[hits["word"]]
            length[place] = self.length[hits["word"]]
            open_[place] = False
        for i in np.flatnonzero(open_):
            crc[i] = zlib.crc32(text[start[i] : end[i]])
        return start, crc, length


@lru_cache(maxsize=2)
def _dictionary(words: tuple[bytes, ...]) -> Dictionary:
    return Dictionary(list(words))


@lru_cache(maxsize=64)
def _after_zeros(power: int) -> np.ndarray:
    """What 2 ** power zero bytes make of each of the 32 bits of a checksum: a linear map."""
    if power == 0:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            columns = np.where(columns & 1, (columns >> np.uint32(1)) ^ np.uint32(0xEDB88320), columns >> np.uint32(1))
        return columns
    return _through(_after_zeros(power - 1), _after_zeros(power - 1))


def _through(columns: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where((crc >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Checksum of two strings, one behind the other, from theirs and the length of the second."""
    length = np.broadcast_to(np.asarray(length, np.int64), left.shape)
    shifted, power = left, 0
    while (length >> power).any():
        shifted = np.where((length >> power) & 1, _through(_after_zeros(power), shifted), shifted)
        power += 1
    return shifted ^ right


def ngram_checksums(crc: np.ndarray, length: np.ndarray, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, checksum) of all runs of 1 to `longest` adjacent words of one text, joined by a blank."""
    texts, sums = [text], [crc]
    blank = np.uint32(zlib.crc32(b" "))
    own = crc
    for n in range(2, longest + 1):
        own = composed(composed(own[:-1], np.broadcast_to(blank, own[:-1].shape), 1), crc[n - 1 :], length[n - 1 :])
        same = text[: len(own)] == text[n - 1 :]
        texts.append(text[: len(own)][same])
        sums.append(own[same])
    return np.concatenate(texts), np.concatenate(sums)


def _pieces(body: bytes) -> Iterator[bytes]:
    """A long folded text in pieces of about a chunk, cut at blanks (or later, where no blank is)."""
    at = 0
    while at < len(body):
        end = body.find(b" ", at + CHUNK_BYTES)
        end = len(body) if end < 0 else end
        yield body[at:end]
        at = end


def bucket_counts(texts: list[bytes], words: Dictionary, longest: int, buckets: int):
    """Per folded text: number of words, of features, and its (text, bucket, count) in order of both."""
    n_words = np.zeros(len(texts), np.int64)
    rows, keys, counts = [], [], []
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK_BYTES:  # alone, piece by piece, with the last words of the piece before
            dense = np.zeros(buckets, np.int64)
            before = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            for piece in _pieces(texts[at]):
                _, crc, length = words.payloads(b" " + piece + b" ")
                crc, length = np.concatenate((before[0], crc)), np.concatenate((before[1], length))
                own = np.zeros(len(crc), np.int64)
                dense += np.bincount(ngram_checksums(crc, length, own, longest)[1] % np.uint32(buckets), minlength=buckets)
                held = len(before[0])  # features within the carried words were counted with the piece before
                again = ngram_checksums(crc[:held], length[:held], own[:held], longest)[1]
                dense -= np.bincount(again % np.uint32(buckets), minlength=buckets)
                n_words[at] += len(crc) - held
                keep = longest - 1
                before = (crc[len(crc) - min(keep, len(crc)) :], length[len(crc) - min(keep, len(crc)) :])
            found = np.flatnonzero(dense)
            rows.append(np.full(len(found), at))
            keys.append(found)
            counts.append(dense[found])
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and len(texts[end]) <= CHUNK_BYTES and size <= CHUNK_BYTES:
            size += len(texts[end]) + 1
            end += 1
        starts = np.cumsum([1, *(len(t) + 1 for t in texts[at : end - 1])])
        start, crc, length = words.payloads(b" " + b" ".join(texts[at:end]) + b" ")
        text = np.searchsorted(starts, start, "right") - 1
        n_words[at:end] = np.bincount(text, minlength=end - at)
        of, sums = ngram_checksums(crc, length, text, longest)
        key, count = np.unique(of * buckets + sums % np.uint32(buckets), return_counts=True)
        rows.append(key // buckets + at)
        keys.append(key % buckets)
        counts.append(count)
        at = end
    rows, keys, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, keys, counts))
    return n_words, rows, keys, counts


def dictionary(texts: DataFrame, size: int = DICTIONARY_WORDS, longest: int = LONGEST) -> list[bytes]:
    """The commonest words of the column `text`, at most `size` words of `longest` bytes.

    Words are taken down to a count, in steps of a twelfth more or so, at which they would be too many:
    a histogram of the counts says which, and only the words taken reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            short = [(w, n) for w, n in held.items() if len(w) <= longest]
            columns = [pa.array([w for w, _ in short], pa.binary()), pa.array([n for _, n in short], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for body in batch.column("body"):
                held.update(body.as_py().translate(_folding()).split())
                if len(held) > HELD_WORDS:
                    yield handed()
                    held.clear()
        yield handed()

    counted = texts.select(_body()).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    step = F.floor(8 * F.log2("n")).alias("step")
    counted = materialize(counted.select("word", "n", step), "words")
    least, total = None, 0
    for own, words in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # 8 * 63 rows at most
        total += words
        if total > size:
            break
        least = own
    if least is None:
        return []
    taken = counted.where(F.col("step") >= least).select("n", "word").collect()  # `size` rows at most
    return [bytes(r["word"]) for r in sorted(taken, key=lambda r: (-r["n"], bytes(r["word"])))]


def _body():
    return F.coalesce("text", F.lit("")).cast("binary").alias("body")


def featured(rows: DataFrame, words: list[bytes], longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Columns of `rows` but text, n_words, n_features, and the buckets of the text with their counts."""
    sent = rows.sparkSession.sparkContext.broadcast(tuple(words))
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _dictionary(sent.value)
        for batch in batches:
            texts = [b.as_py().translate(_folding()) for b in batch.column("body")]
            n_words, row, bucket, count = bucket_counts(texts, known, longest, buckets)
            ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            total = np.append(0, np.cumsum(count))
            n_features = total[ends[1:]] - total[ends[:-1]]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (bucket, count)]
            columns = [*(batch.column(f.name) for f in kept), pa.array(n_words), pa.array(n_features), *lists]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "n_words", "n_features", "buckets", "counts"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = f"{own + ', ' if own else ''}n_words long, n_features long, buckets array<int>, counts array<int>"
    return rows.select(*(f.name for f in kept), _body()).mapInArrow(run, schema)


def totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows: one array of fixed size per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, count = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
            np.add.at(total, bucket, count)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = features.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in summed.collect():  # one row per bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, each bucket having one feature more, rounded down."""
    size = len(source)
    above = (target + 1.0) * (source.sum() + float(size))
    below = (source + 1.0) * (target.sum() + float(size))
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    seed: str = "2024",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn), one row per row of `docs`.

    `docs` has doc_id and text, `target` has text. Of documents of `least_words` words and more,
    `percent` in a hundred (rounded down) are drawn by the highest score.
    """
    both = docs.select("text").unionByName(target.select("text"))
    words = dictionary(both)
    features = materialize(featured(docs.select("doc_id", "text"), words, longest, buckets), "features")
    wanted = featured(target.select("text"), words, longest, buckets)
    sent = docs.sparkSession.sparkContext.broadcast(gains(totals(features, buckets), totals(wanted, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
            sums = np.append(0, np.cumsum(sent.value[bucket] * count))
            ends = np.append(0, np.cumsum(batch.column("buckets").value_lengths().to_numpy(zero_copy_only=False)))
            weight = sums[ends[1:]] - sums[ends[:-1]]
            names = ["doc_id", "n_words", "n_features"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(weight)], [*names, "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = features.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise), "scored")

    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    ranked = ordered_rows(scored.where(able).withColumn("down", -F.col("score")), ["down", "doc_id", "weight", "n_features"], "place").df
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.cast("long").alias("rank")).unionByName(rest)


#: CRC-32 bit by bit: each byte is folded in, then eight steps of the reversed polynomial.
SQL = r"""
WITH texts AS (
  SELECT doc_id, true AS own, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT item_id, false, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark
), words AS (
  SELECT own, doc_id, unnest(w) AS word FROM texts
), counted AS (
  SELECT own, doc_id, word, count(*) AS n FROM words GROUP BY ALL
), hashed AS (
  SELECT word, hex(encode(word)) AS code FROM counted GROUP BY word
), crc AS (
  SELECT word, CAST(xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, CAST(length(code) / 2 AS BIGINT) + 1),
      lambda i: (16 * (instr('0123456789ABCDEF', substr(code, CAST(2 * i - 1 AS BIGINT), 1)) - 1)
        + instr('0123456789ABCDEF', substr(code, CAST(2 * i AS BIGINT), 1)) - 1)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS BIGINT) % 10000 AS bucket FROM hashed
), features AS (
  SELECT own, doc_id, bucket, sum(n) AS n FROM counted JOIN crc USING (word) GROUP BY ALL
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM features GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM buckets, sums
), weights AS (
  SELECT doc_id, sum(n * gain) AS weight FROM features JOIN gains USING (bucket) WHERE own GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(((('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
      AS BIGINT) AS score
  FROM texts d LEFT JOIN weights g ON d.doc_id = g.doc_id WHERE own
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= (10 * able) // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""


@register("op12_importance_resampling", sql=SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
