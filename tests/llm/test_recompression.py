from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridcast.llm import recompression
from gridcast.llm.recompression import anchored, op13_substring_dedup, without_repeats


def brute_force(rows, window=20):
    """Rows as (doc_id, text, …); of equal rows the first is the earliest."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    words = [(r[1] or "").encode().split() for r in rows]
    seen, out = set(), []
    for i in order:
        gone = set()
        for at in range(len(words[i]) - window + 1):
            body = tuple(words[i][at : at + window])
            if body in seen:
                gone.update(range(at, at + window))
            seen.add(body)
        kept = b" ".join(w for j, w in enumerate(words[i]) if j not in gone)
        out.append((rows[i][0], len(words[i]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def by_operator(spark, docs_of, written, rows):
    folder = written(documents=docs_of([(r[0], r[1]) for r in rows]).withColumnRenamed("n_chars", "print"))
    return result(op13_substring_dedup(spark, folder))


def passages(rng, vocabulary, count, longest):
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(5)]
    rows = []
    for doc in range(count):
        text = [rng.choice(words) for _ in range(rng.randint(0, longest))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(shared)
        rows.append((doc, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


@pytest.mark.parametrize("vocabulary", [1, 2, 5, 500])
def test_matches_brute_force(spark, docs_of, written, vocabulary):
    rows = passages(random.Random(vocabulary), vocabulary, 60, 120)
    assert by_operator(spark, docs_of, written, rows) == brute_force(rows)


def test_periods_and_runs(spark, docs_of, written):
    thue_morse = [bin(i).count("1") % 2 for i in range(600)]
    rows = [
        (1, "a " * 500), (2, "a b " * 300), (3, " ".join("ab"[b] for b in thue_morse)),
        (4, " ".join("ab"[b] for b in thue_morse[100:400])), (5, "a b c d e f g " * 40), (6, "x " * 19), (7, "x " * 20), (8, "x " * 21),
    ]
    assert by_operator(spark, docs_of, written, rows) == brute_force(rows)


def test_nulls_empty_equal_rows_and_odd_blanks(spark, docs_of, written):
    text = " ".join(f"v{i}" for i in range(45))
    rows = [
        (None, text), (None, None), (3, text), (3, text), (3, text + " more"), (4, ""), (5, "few words"), (6, "few words"),
        (7, " ".join(f"v{i}" for i in range(45))), (8, "Ä " * 30 + "  " * 30), (-9, text.replace(" ", "\x0b")),
    ]
    got = by_operator(spark, docs_of, written, rows)
    # Rows with one id follow the digest of their texts.
    longer = int(hashlib.sha256((text + " more").encode()).hexdigest()[:15], 16) < int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
    rows[2:5] = [(3, text + " more"), (3, text), (3, text)] if longer else rows[2:5]
    assert got == brute_force(rows)


def test_empty_table(spark, docs_of, written):
    assert by_operator(spark, docs_of, written, []) == []


@pytest.mark.parametrize("size", [50, 64, 1000])
def test_every_window_of_a_long_text_is_in_one_stretch(monkeypatch, size):
    monkeypatch.setattr(recompression, "CHUNK_WORDS", size)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 4000)}" for _ in range(n)) for n in (3000, 19, 20, 21, 69, 70, 0)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array([5] * len(texts)), pa.array([t.encode() for t in texts])], ["doc_id", "print", "body"]
    )
    windows = Counter()
    for out in recompression._anchor_rows(20, 2, 3)([batch]):
        for r in out.to_pylist():
            windows.update((r["doc_id"], p) for p in range(r["start"], r["start"] + r["n"]))
    assert windows == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t.split()) - 19))


def test_long_text(spark, docs_of, written):
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 4000)}" for _ in range(3000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[500:900])), (3, " ".join(long[20:45] + ["z"] + long[2000:2300]))]
    assert by_operator(spark, docs_of, written, rows) == brute_force(rows)


def test_hot_keys_are_split_without_changing_the_result(spark, docs_of, written, monkeypatch):
    monkeypatch.setattr(recompression, "HOT_ROWS", 3)
    monkeypatch.setattr(recompression, "SAMPLE", 1)
    rng = random.Random(4)
    phrase = [f"p{i}" for i in range(14)]
    rows = []
    for doc in range(80):
        around = [f"u{rng.randint(0, 10**6)}" for _ in range(20)]
        rows.append((doc, " ".join([*around[:10], *phrase, *(["same"] * 8 if doc % 3 else around), *around[10:]])))
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    assert by_operator(spark, docs_of, written, rows) == brute_force(rows)


def test_every_window_is_in_one_row_and_equal_windows_share_their_key():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 30, (400, 1), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    names = np.repeat(names, 2, axis=1)
    names[200:260] = names[40:100]
    barrier = np.zeros(400, bool)
    barrier[[0, 150, 399]] = True
    names[barrier] = np.array([[1, 1], [2, 2], [3, 3]], np.uint64)
    found = anchored(names, barrier, 20, 2, 7)
    windows = np.concatenate([np.arange(a, a + n) for a, n in zip(found["at"], found["n"], strict=True)])
    keys = np.repeat(found["key"], found["n"])
    assert sorted(windows) == [*range(1, 131), *range(151, 380)]
    key = dict(zip(windows, keys, strict=True))
    assert all(key[40 + i] == key[200 + i] for i in range(41))


def test_other_window_and_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "two three"), (None, "three four")], "doc_id string, text string")
    kept = {r["doc_id"]: r["kept"] for r in without_repeats(docs, window=2).collect()}
    assert kept == {None: "three four", "a": "two three", "b": "one"}
