"""Token counts of whole texts, huge ones by overlapping chunks.

A huge text is encoded chunk by chunk, each chunk reaching into the next one. Two neighbours are
spliced at a stable common boundary inside their overlap: a place after white space, before which
neither encoding has a token that reaches across, and around which both agree on the tokens. Where
there is none, the overlap is widened, in the end to the rest of the text.

Such a boundary is proven stable for a vocabulary whose splitting drops white space, as the word
vocabulary used here does: no token, normalisation or special string crosses it, so whatever stands
on one side has no influence on the other. For the same reason the counts of short texts are summed
over their pieces between white space, which the library encodes once per worker and piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.bpe import word_vocabulary
from gridcast.llm.registry import register, table

#: Characters of a chunk, and of its first reach into the next one; longer texts are huge.
CHUNK_CHARS = 50_000
OVERLAP_CHARS = 500
#: Tokens on which both encodings have to agree on either side of a splice.
AGREED_TOKENS = 4
#: Pieces whose counts a worker remembers; the memory starts anew when it is full.
MEMO_PIECES = 1_000_000
MEMO_CHARS = 64
BATCH_ROWS = 256
LIMIT = 2048
# Fixed value: ASCII white space, which every split of the vocabulary drops.
BLANKS = " \t\n\r\x0b\x0c"


class Counter:
    """Counts tokens as the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
        """Tokens of each text."""
        huge = {i: self.spliced(t, chunk, overlap) for i, t in enumerate(texts) if len(t) > chunk}
        pieces = [[] if i in huge else t.replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        known = self.known
        if len(known) >= MEMO_PIECES:
            known.clear()
        fresh = [*{piece for own in pieces for piece in own if piece not in known}]
        found = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        sizes = dict(zip(fresh, map(len, found), strict=True))
        known.update((p, n) for p, n in sizes.items() if len(p) <= MEMO_CHARS)
        sizes = {p: n for p, n in sizes.items() if len(p) > MEMO_CHARS}
        if sizes:
            count = lambda p: known[p] if p in known else sizes[p]
        else:
            count = known.__getitem__
        return [huge[i] if i in huge else sum(map(count, own)) for i, own in enumerate(pieces)]

    def _tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a long text, of which no more than a chunk and its reach is encoded at once."""
        total, start = 0, 0  # `start` is a stable boundary: all before it is counted
        while True:
            reach, cut = overlap, None
            while cut is None and start + chunk < len(text):
                middle, end = start + chunk, min(len(text), start + chunk + reach)
                cut = self._splice(text, start, middle, end)
                reach *= 2
                if end == len(text):
                    break
            if cut is None:  # the last chunk, or no boundary up to the end of the text
                return total + len(self._tokens(text[start:])[0])
            place, counted = cut
            total, start = total + counted, place

    def _splice(self, text: str, start: int, middle: int, end: int) -> tuple[int, int] | None:
        """A stable boundary in [middle, end) and the tokens of [start, boundary), if there is one."""
        ids, spans = self._tokens(text[start:end])
        later_ids, later_spans = self._tokens(text[middle:end])
        later = {a + middle: i for i, (a, _) in enumerate(later_spans)}
        for i in range(len(ids) - 1, 0, -1):
            place = spans[i][0] + start
            if place <= middle:
                return None
            k = later.get(place)
            if k is None or text[place - 1] not in BLANKS or spans[i - 1][1] + start > place:
                continue
            if k < AGREED_TOKENS or i + AGREED_TOKENS > len(ids):
                continue  # too near an end of the overlap to compare
            near = slice(i - AGREED_TOKENS, i + AGREED_TOKENS)
            if ids[near] == later_ids[k - AGREED_TOKENS : k + AGREED_TOKENS]:
                return place, i
        return None


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    A null text counts as empty, with no bytes and no tokens. Rows are independent; repeated rows
    give repeated results, no rows give none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = count.counts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), size.alias("n_bytes"))
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), word_vocabulary())
