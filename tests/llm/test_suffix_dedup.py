from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from gridcast.llm import suffix_dedup as s
from gridcast.llm.registry import RUNS


def plain(texts, length=400):
    """n_bytes, n_removed, n_spans, digest of the rest, by counting every string."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = [prose(n) for n in (60, 75, 90, 120, 400)]
    texts = [None, "", "x", "y" * 399, "z" * 400, "w" * 401, "the " * 300, "the " * 150 + prose(100), "the " * 260 + "end"]
    for _ in range(40):
        texts.append("".join(rng.choice([prose(rng.randint(1, 60)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 90) :], "\n"]) for _ in range(4)))
    base = prose(500)
    texts += [base, base, base[:1000] + "!" + base[1001:], base[7:-9], shared[4] + shared[4], base + base[::-1]]
    return texts


def test_index_finds_all_long_matches():
    rng = random.Random(2)
    for alphabet, size in (("ab", 200), ("a", 40), ("abcdefgh", 900)):
        shared = ["".join(rng.choices(alphabet, k=size)) for _ in range(4)]
        contexts = sorted({"".join(rng.choice([*shared, "".join(rng.choices(alphabet, k=9))])[: rng.randint(5, size)] for _ in range(3)).encode() for _ in range(30)})
        for length in (5, 17):
            seen = Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
            expected = [v for c in contexts for v in [*(i + length <= len(c) and seen[c[i : i + length]] > 1 for i in range(len(c))), False]]
            assert s.long_matches(contexts, length).tolist() == expected


@pytest.mark.parametrize("limits", [{}, {"INDEXED_CONTEXTS": 2, "SHARD_BYTES": 3000}])
def test_equals_brute_force(spark, docs_of, written, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(s, name, value)
    rows = [*enumerate(corpus()), (None, "n" * 500), (None, None), (3, "other text of the same id"), (50, corpus()[50])]
    got = RUNS["op10_suffix_array_dedup"](spark, written(documents=docs_of(rows)))
    expected = [(i, *rest) for (i, _), rest in zip(rows, plain([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_long_documents_come_in_parts(monkeypatch, weak):
    """Equal digests of contexts mean equal bytes, also where the digests that pick anchors collide all the time."""
    monkeypatch.setattr(s, "STRETCH_BITS", 10)
    if weak:
        of = s.Digests.of
        monkeypatch.setattr(s.Digests, "of", lambda self, a, b: of(self, a, b) & np.uint64(3 << 62))
    s._powers.cache_clear()
    data = " ".join(t or "" for t in corpus()).encode()
    seen = {}
    starts = []
    for found in s.stretches(np.frombuffer(data, np.uint8)):
        for anchor, context, check, a, b in zip(*(f.tolist() for f in found)):
            starts += range(a, b + 1)
            assert seen.setdefault((anchor, context, check), data[a : b + 400]) == data[a : b + 400]
    s._powers.cache_clear()
    assert starts == list(range(len(data) - 399))


def test_one_start_speaks_for_those_of_its_batch():
    rng = random.Random(8)
    rows = []
    for place in range(400):
        digest = rng.randint(0, 90)
        rows.append((digest, digest % 7, rng.choice([1, 2]), 5, place * rng.choice([1, 1, 3]), rng.choice([1, 1, 1, 2]), rng.random() < 0.1))
    rows = list({(r[2], r[3], r[4], r[6]): r for r in rows}.values())
    starts = np.array(rows, s._HOT)
    times = Counter()
    for d, c, *_, copies, _ in rows:
        times[d, c] += copies
    want = {(None if null else doc, key, place) for d, c, doc, key, place, copies, null in rows if times[d, c] > 1 and copies == 1}
    got = []
    for parts in ([starts], [starts[:150], starts[150:]]):
        bodies, marks = [], []
        for part in parts:
            own, known = s._spoken_for(part)
            assert len(own) == len({(r["digest"], r["check"]) for r in part})
            assert (s._starts(s._columns(own)) == own).all()
            bodies.append(s.zstandard.compress(s._columns(own)))
            marks += known
        marks += s._counted(bodies)
        got.append({(doc, key, p) for doc, key, a, b in marks for p in range(a, b - s.LENGTH + 1)})
    assert got == [want, want]


def test_empty_table(spark, docs_of, written):
    assert RUNS["op10_suffix_array_dedup"](spark, written(documents=docs_of([]))).count() == 0
