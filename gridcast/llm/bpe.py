"""BPE encoding and decoding with a public vocabulary.

A word is encoded by a priority queue of merge ranks over a doubly linked list of symbols: the
lowest rank is taken first, entries whose symbols have changed meanwhile are skipped, and a merge
offers the new symbol's pairs with its two neighbours. Decoding looks up the vocabulary's string of
each id and joins them, with one space where the vocabulary file names no decoder.

The text is prepared as such a file declares it: special strings are cut out of the raw text, the
rest is put into NFC, folded to lower case and split into contractions, runs of letters, single
digits and runs of other signs; white space is dropped. No word reaches across white space, so the
encodings of words, and of pieces between blanks, are remembered in each worker up to a bound.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from unicodedata import is_normalized, normalize

from gridcast.llm.registry import register, table

#: Words, and pieces with their punctuation, that a worker remembers (some 200 bytes each); the
#: memory of either starts anew when it is full.
MEMO_WORDS = 700_000
MEMO_PIECES = 300_000
#: Longest word or piece that is remembered; longer ones are encoded whenever they come.
MEMO_CHARS = 64
#: Rows that are encoded at once.
BATCH_ROWS = 256
END_OF_WORD = "</w>"
# Fixed value: the split pattern that the vocabulary file declares.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one above 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Merges and strings of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in [*ids.items(), *self.special.items()]}
        # left id -> right id -> rank, and the symbol that the merge of a rank makes
        self.merges = [{} for _ in range(max(ids.values()) + 1)]
        self.merged = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[ids[left]][ids[right]] = rank
            self.merged.append(ids[left + right])
        inner = byte_symbols()
        self.inner = [ids[s] for s in inner]
        self.last = [ids[s + END_OF_WORD] for s in inner]
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word of the split."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        merges, merged = self.merges, self.merged
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # An entry is rank and place in one number. It is stale when the pair that now begins at
        # its place has another rank, or none.
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue = []
        for i in range(n - 1):
            rank = merges[symbols[i]].get(symbols[i + 1])
            if rank is not None:
                queue.append(rank << shift | i)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            i = entry & mask
            j = after[i]
            if j >= n or (left := symbols[i]) < 0:
                continue
            rank = entry >> shift
            if merges[left].get(symbols[j]) != rank:
                continue
            symbols[i] = new = merged[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = merges[new].get(symbols[k])
                if rank is not None:
                    push(queue, rank << shift | i)
            h = before[i]
            if h >= 0:
                rank = merges[symbols[h]].get(new)
                if rank is not None:
                    push(queue, rank << shift | h)
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str) -> bytes:
        """Ids of a piece of prepared text as the bytes of 32-bit numbers."""
        known, ids = self.words, b""
        for word in self.split.findall(piece):
            one = known.get(word)
            if one is None:
                one = array("i", self.word(word)).tobytes()
                if len(word) <= MEMO_CHARS:
                    if len(known) >= MEMO_WORDS:
                        known.clear()
                    known[word] = one
            ids = ids + one if ids else one
        if len(piece) <= MEMO_CHARS:
            if len(self.pieces) >= MEMO_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as the bytes of 32-bit numbers."""
        if self.cut is None or "<" not in text:
            return self._plain(text)
        return b"".join(
            array("i", [self.special[part]]).tobytes() if part in self.special else self._plain(part)
            for part in self.cut.split(text)
        )

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not is_normalized("NFC", text):
                text = normalize("NFC", text)
            text = text.replace("Σ", "σ")  # folded sign by sign, so never to a final sigma
        pieces = text.lower().replace("\n", " ").split(" ")  # other white space stays in a piece and is dropped there
        piece = self.piece
        found = map(self.pieces.get, pieces)
        return b"".join([ids if ids is not None else piece(one) for ids, one in zip(found, pieces)])

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker."""
    return Vocabulary(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def _encoded(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """The text, the last column, replaced by `ids` and `n_tokens`."""
    for part in _slices(batches):
        *rest, texts = part.columns
        found = [known.encode(t or "") for t in texts.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
        yield pa.RecordBatch.from_arrays([*rest, ids, pa.array(sizes)], [*part.schema.names[:-1], "ids", "n_tokens"])


def _decoded(batches: Iterator[pa.RecordBatch], known: Vocabulary, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    """With the text of `ids` as column `out`."""
    for part in _slices(batches):
        texts = [known.decode(one.values.to_pylist()) if one.is_valid else "" for one in part.column(ids)]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])


def _chosen(docs: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, T.StructType]:
    """The `keep` columns and the text, and the schema of the encoded rows."""
    kept = docs.select(*(docs[c] for c in keep))
    schema = T.StructType([*kept.schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return docs.select(*(docs[c] for c in keep), docs[text].alias("_text")), schema


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, `ids` (array of int) and `n_tokens` of every row of `docs`.

    A null text counts as empty: no ids. Rows are independent of each other; repeated rows give
    repeated results, no rows give none. A text of any length is encoded whole, and `path` is read
    where the task runs.
    """
    rows, schema = _chosen(docs, text, keep)
    return rows.mapInArrow(lambda batches: _encoded(batches, vocabulary(path)), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids as column `out`. Null ids count as none and give an empty text."""
    schema = T.StructType([*encoded.schema, T.StructField(out, T.StringType())])
    return encoded.mapInArrow(lambda batches: _decoded(batches, vocabulary(path), ids, out), schema)


def recode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What `decode` makes of what `encode` makes of `docs`, in one worker: the ids don't leave it in between."""
    rows, schema = _chosen(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        return _decoded(_encoded(batches, known), known, "ids", "decoded")

    return rows.mapInArrow(run, T.StructType([*schema, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encoded and decoded again, with digests: the `keep` columns, n_tokens, ids_sha256, decoded_sha256."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return recode(docs, path, keep=keep).select(
        *keep, "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), word_vocabulary())
