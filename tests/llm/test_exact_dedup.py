from __future__ import annotations

import hashlib

import numpy as np
import pytest
from gridcast.llm import exact_dedup as e

ROWS = [
    (1, "Same TEXT"), (2, "same text"), (3, "same text "), (4, None), (5, ""), (6, "Ä"), (7, "ä"), (8, "x" * 50_000), (9, "X" * 50_000),
    (None, "same text"), (None, "lonely"), (None, "lonely"), (10, "twice"), (10, "twice"), (11, "other"), (11, "text of the same id"),
]


def plain(rows):
    folded = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows]
    out = []
    for i, text in folded:
        ids = [j for j, other in folded if other == text]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 999, 20_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    seed, cells = e.build_filter(keys)
    assert e.in_filter(keys, len(keys), seed, cells).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert e.in_filter(others, len(keys), seed, cells).mean() < 0.02 or n == 0


def test_one_batch_without_a_snapshot_and_all_in_snapshots(docs_of):
    docs = docs_of(ROWS)
    for parts in ((docs,), (docs.limit(0), docs), e.arrivals(docs)):
        assert sorted(map(tuple, e.exact_groups(*parts).collect()), key=str) == plain(ROWS)


def test_digest_collisions_are_told_apart_by_bytes(docs_of, monkeypatch):
    """Every digest is the same; the bytes decide."""
    monkeypatch.setattr(e.F, "sha2", lambda column, bits: e.F.lit("same"))
    got = e.exact_groups(docs_of(ROWS)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in plain(ROWS)), key=str)


def test_positives_only_meet_the_entries(spark, docs_of):
    old = docs_of([(i, f"old {i}") for i in range(300)])
    new = docs_of([(1000 + i, f"old {i}" if i < 20 else f"new {i}") for i in range(300)])
    snapshot = e.seal(e.digests(old))
    screened = e.screened(e._groups(e.digests(new)), snapshot)
    assert 20 <= screened.where("maybe").count() < 60


@pytest.mark.parametrize("old", [0, 40])
def test_large_batch_and_one_text_in_half_of_all_rows(docs_of, monkeypatch, old):
    """Buckets of two digests: the batch is dealt into many parts, the hot text into many tasks."""
    monkeypatch.setattr(e, "BUCKET_KEYS", 2)
    monkeypatch.setattr(e, "COPIES", 3)
    monkeypatch.setattr(e, "HEAVY_KEYS", 10)
    monkeypatch.setattr("gridcast.llm.common.HEAVY_ROWS", 5)
    rows = ROWS + [(100 + i, "hot text" if i % 2 else f"text {i % 60}") for i in range(200)]
    got = e.exact_groups(docs_of(rows[:old]), docs_of(rows[old:])).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    monkeypatch.setattr(e.F, "sha2", lambda column, bits: e.F.lit("same"))
    got = e.exact_groups(docs_of(rows[:old]), docs_of(rows[old:])).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in plain(rows)), key=str)


def test_every_part_of_a_batch_meets_the_filter(docs_of, monkeypatch):
    old = docs_of([(i, f"old {i}") for i in range(30)])
    new = docs_of([(1000 + i, f"old {i}" if i < 30 else f"new {i}") for i in range(400)])
    snapshot = e.seal(e.digests(old))
    monkeypatch.setattr(e, "BUCKET_KEYS", 10)
    screened = e.screened(e._groups(e.digests(new)), snapshot)
    assert screened.count() == 400 and 30 <= screened.where("maybe").count() < 60


def test_deduplicate_keeps_columns(docs_of):
    docs = docs_of([(1, "A", "en", "s"), (2, "a", None, None), (3, None), (None, "b"), (None, "B")])
    kept = e.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None", "None"]


def test_empty_table(docs_of):
    assert e.exact_groups(docs_of([])).count() == 0
    assert e.deduplicate(docs_of([])).count() == 0
