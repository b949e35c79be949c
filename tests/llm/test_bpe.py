from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from gridcast.llm import bpe, token_counts
from gridcast.llm.registry import RUNS
from tokenizers import Tokenizer

TEXTS = [
    None, "", " ", "\n\t", "Hello world", "It's I'LL don’t 'S 're", "<|endoftext|>", "a<|startoftext|>b<|ENDOFTEXT|> <|endoftext|", "Σ ΑΣ ΣΑΣ.",
    "a\x1cb a\x85c d e  f", "x" * 5000, "123 4５６ ½", "İstanbul ẞ", "é é", "\U0001f600‍ zwj", "naïve café – Zürich", "a" * 70 + " " + "b" * 65,
]


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlué'-.,", k=rng.randint(1, 14))) for _ in range(300)]
    return [*TEXTS, *(" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(30))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.word_vocabulary())


def test_round_trip_equals_the_library(spark, docs_of, written, library):
    rows = [*enumerate(texts()), (None, "null id"), (3, "again"), (3, "again")]
    got = RUNS["op2_bpe_round_trip"](spark, written(documents=docs_of(rows).withColumnRenamed("lang", "ids")))
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((i, len(ids), digest(" ".join(map(str, ids))), digest(decoded)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_memory_of_words_is_bounded_and_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    own = bpe.Vocabulary(bpe.word_vocabulary())
    for text in texts():
        ids = np.frombuffer(own.encode(text or ""), np.int32).tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids
        assert len(own.words) <= 5 and len(own.pieces) <= 3


def test_token_counts_equal_the_library(spark, docs_of, written, library):
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 12))) for _ in range(500)]
    huge = [" ".join(rng.choices(words, k=30_000)), "z" * 120_000, "\n".join(rng.choices(words, k=20_000)) + "<|endoftext|>" * 9]
    rows = [*enumerate([*texts(), *huge]), (None, "null id"), (3, "again"), (3, "again")]
    got = RUNS["op7_token_counts"](spark, written(documents=docs_of(rows).withColumnRenamed("lang", "n_tokens")))
    sizes = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    expected = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, sizes, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 1), (100, 5), (300, 20), (1000, 64)])
def test_splices_hold_for_any_chunk(library, chunk, overlap):
    count = token_counts.counter(bpe.word_vocabulary())
    for text in [*texts(), "x" * 700 + " a b c d e f <|endoftext|> g" * 20, "ab " * 400, "q" * 1500]:
        assert count.spliced(text or "", chunk, overlap) == len(library.encode(text or "", add_special_tokens=False).ids)


def test_empty_table(spark, docs_of, written):
    folder = written(documents=docs_of([]))
    assert RUNS["op2_bpe_round_trip"](spark, folder).count() == 0
    assert RUNS["op7_token_counts"](spark, folder).count() == 0
