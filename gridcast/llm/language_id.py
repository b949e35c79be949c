"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counting, over all labelled training rows, and scoring are both batches of numpy work in tasks: a
text becomes an array of code points, its n-grams become bucket numbers, and a score is the sum of
the rows of the log-probability matrix at these buckets. Only bucket counts per language travel:
languages x buckets numbers per task at most, which `MATRIX_CELLS` bounds, however large the input.
The broadcast matrix has the same bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.registry import register, table

#: Orders of the n-grams.
ORDERS = (1, 2, 3, 4)
#: Most hash buckets, and most cells of the matrix: with many languages there are fewer buckets.
BUCKETS = 1 << 16
MATRIX_CELLS = 1 << 24
#: Added to every count.
SMOOTHING = 0.5
#: Code points that are hashed at once; n-grams that straddle two stretches are kept.
STRETCH = 1 << 20
UNKNOWN = "und"
_SPACE = 0x20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_points(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with every run of non-letters as one blank; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points
    letter = _letters()[points]
    if not letter.any():
        return points[:0]
    kept = letter | np.concatenate(([True], letter[:-1]))  # letters, and the first sign after each run of them
    points = np.where(letter, points, np.uint32(_SPACE))[kept]
    edge = np.full(1, _SPACE, np.uint32)
    return np.concatenate((edge if points[0] != _SPACE else edge[:0], points, edge if points[-1] != _SPACE else edge[:0]))


def ngram_buckets(points: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, stretch by stretch; `buckets` is a power of two."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    reach = max(ORDERS) - 1
    for start in range(0, len(points), STRETCH):
        part = points[start : start + STRETCH + reach].astype(np.uint64)
        own = min(STRETCH, len(points) - start)
        h = np.zeros(len(part), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            h = h[: len(part) - order + 1]
            if not len(h):
                break
            h = (h ^ part[order - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if order in ORDERS:
                # grams that begin in the reach belong to the next stretch
                yield ((h[:own] * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages in order, bucket count, log probabilities (buckets x languages), log priors."""

    languages: list[str]
    buckets: int
    logs: np.ndarray
    priors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior probability; `und` and 0 without a letter, or without a model."""
        points = letter_points(text)
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0
        total = self.priors.copy()
        for found in ngram_buckets(points, self.buckets):
            total += self.logs[found].sum(axis=0, dtype=np.float64)
        total -= total.max()
        odds = np.exp(total)
        best = int(np.argmax(total))  # ties go to the first language in code-point order
        return self.languages[best], float(odds[best] / odds.sum())


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows of `docs` whose language is not null. No such rows give a model without languages."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    priors = dict(sorted((r["lang"], r["count"]) for r in sizes))
    languages = list(priors)
    if not languages:
        return Model([], 0, np.zeros((0, 0), np.float32), np.zeros(0))
    buckets = BUCKETS
    while buckets > 256 and buckets * len(languages) > MATRIX_CELLS:
        buckets //= 2
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(batch.column("text"), batch.column("lang"), strict=True):
                own = counts.setdefault(number[name.as_py()], np.zeros(buckets, np.int64))
                for found in ngram_buckets(letter_points(text.as_py()), buckets):
                    own += np.bincount(found, minlength=buckets)
        for i, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"]
            )

    summed = rows.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # languages x buckets rows at most
    counts = np.zeros((buckets, len(languages)))
    counts[found["bucket"], found["lang"]] = found["n"]
    logs = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(axis=0))
    share = np.array([priors[name] for name in languages], np.float64)
    return Model(languages, buckets, logs.astype(np.float32), np.log(share / share.sum()))


def predict(
    docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """`docs` with the predicted language and its score as columns `out`; columns so named are replaced.

    The language is `und`, the score 0, where the text is null, empty or without a letter. Rows are
    independent of each other, whole texts are read whatever their length, and no rows give none.
    """
    docs = docs.drop(*out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(text)]
            names = pa.array([name for name, _ in found], pa.string())
            scores = pa.array([score for _, score in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, scores], [*batch.schema.names, *out])

    added = [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema, *added]))


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the rows by a checksum of the id: not for training. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """`docs` with lang_pred, score; trained on the labelled rows of `docs` that are not held out."""
    return predict(docs, train(docs.where(~held_out())))


def identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, whose language could be told. Clashing columns are kept as they are."""
    return predict(docs, train(docs.where(~held_out())), out=("_lang_pred", "_score")).where(
        F.col("_lang_pred") != UNKNOWN
    ).drop("_lang_pred", "_score")


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    return identify(rows).select("doc_id", "held_out", "lang_pred", "score")
