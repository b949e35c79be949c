from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridcast.llm import importance
from gridcast.llm.importance import Dictionary, bucket_counts, composed, dictionary, op12_importance_resampling, resample

BUCKETS = 10_000


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features_of(text, longest=1):
    words = words_of(text)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return Counter(zlib.crc32(f.encode()) % BUCKETS for f in runs)


def brute_force(rows, target, longest=1):
    feats = [features_of(r[1], longest) for r in rows]
    source, wanted = sum(feats, Counter()), sum((features_of(t, longest) for t in target), Counter())
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {
        b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + 10000.0) / ((source[b] + 1.0) * (t_all + 10000.0)))) for b in source | wanted
    }
    out = []
    for (doc, text, *_), own in zip(rows, feats, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[b] for b, n in own.items())
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, sum(own.values()), weight, score, None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for place, row in enumerate(able[: 10 * len(able) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def random_rows(count, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "éa", "x1", "naïve", "İs", "日本", "a_b", "ß", *(f"w{i}" for i in range(200))]
    gaps = [" ", "  ", ", ", "\n", "-", "\x00", " "]
    rows = []
    for doc in range(count):
        text = "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.choice([0, 5, 20, 21, 60, 200])))
        rows.append((doc, text))
    return rows


def target_rows(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "item_id long, text string, buckets string")


def test_query_matches_brute_force(spark, docs_of, written):
    rows = random_rows(120)
    rows += [(None, None), (None, rows[3][1]), (5, rows[7][1]), (5, rows[7][1]), (900, "!!! ---"), (901, ""), (902, "x1 " * 19), (903, "x1 " * 20)]
    target = [rows[2][1], None, "", "日本 w1 w2"]
    folder = written(documents=docs_of(rows).withColumnRenamed("n_chars", "score"), benchmark=target_rows(spark, target))
    assert result(op12_importance_resampling(spark, folder)) == brute_force(rows, target)


@pytest.mark.parametrize("known", [0, 3, 1000])
def test_dictionary_changes_no_result(known):
    texts = [r[1].encode().translate(importance._folding()) for r in random_rows(40, 2)]
    words = [w for w, _ in Counter(w for t in texts for w in t.split()).most_common(known)]
    n_words, row, bucket, count = bucket_counts(texts, Dictionary(words), 3, BUCKETS)
    for i, (_, text) in enumerate(random_rows(40, 2)):
        own = row == i
        assert dict(zip(bucket[own].tolist(), count[own].tolist(), strict=True)) == dict(features_of(text, 3))
        assert n_words[i] == len(words_of(text))


def test_payloads_come_from_the_automaton():
    known = Dictionary([b"ab", b"b", b"abc"])
    start, crc, length = known.payloads(b" ab b  abc abcd b ab ")
    assert start.tolist() == [1, 4, 7, 11, 16, 18] and length.tolist() == [2, 1, 3, 4, 1, 2]
    assert crc.tolist() == [zlib.crc32(w) for w in (b"ab", b"b", b"abc", b"abcd", b"b", b"ab")]
    assert [end for end, _ in known.automaton.iter(" ab b  abc abcd b ab ")] == [3, 5, 10, 17, 20]


def test_composed_checksums():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 300))) for _ in range(200)]
    left, right = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = composed(left, right, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_long_texts_in_pieces(monkeypatch, longest):
    monkeypatch.setattr(importance, "CHUNK_BYTES", 64)
    rows = [*random_rows(12, 4), (99, "onelongword" * 40), (100, "w1 " + "onelongword" * 40 + " w2 w3")]
    texts = [t.encode().translate(importance._folding()) for _, t in rows]
    n_words, row, bucket, count = bucket_counts(texts, Dictionary([b"w1", b"the"]), longest, BUCKETS)
    for i, (_, text) in enumerate(rows):
        own = row == i
        assert dict(zip(bucket[own].tolist(), count[own].tolist(), strict=True)) == dict(features_of(text, longest))
        assert n_words[i] == len(words_of(text))


def test_dictionary_is_bounded_and_by_count(spark, monkeypatch):
    monkeypatch.setattr(importance, "HELD_WORDS", 2)
    docs = spark.createDataFrame([("A a b",), ("b! c a",), ("loooooooooong " * 9,), (None,)], "text string")
    assert dictionary(docs, 3, 10) == [b"a", b"b", b"c"]
    assert dictionary(docs, 1, 100) == [b"loooooooooong"]


def test_empty_tables(spark, docs_of):
    none = target_rows(spark, []).select("text")
    assert result(resample(docs_of([]), none)) == []
    rows = random_rows(30, 6)
    assert result(resample(docs_of(rows), none)) == brute_force(rows, [])


def test_bigrams_and_percent(spark, docs_of):
    rows = random_rows(50, 7)
    target = [rows[1][1], rows[5][1]]
    drawn = resample(docs_of(rows), target_rows(spark, target), longest=2)
    assert result(drawn) == brute_force(rows, target, 2)
    able = sum(len(words_of(t)) >= 20 for _, t in rows)
    half = resample(docs_of(rows), target_rows(spark, target), percent=50).where("rank is not null").count()
    assert half == able // 2
