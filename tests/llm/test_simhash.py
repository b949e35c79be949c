from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from gridcast.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, distance=4):
    """Least id per row by comparing all pairs."""
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "a b c d", "A b C d e", "x y Ä\x1cz b c d", "w " * 9])
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_is_hashed_in_stretches(monkeypatch):
    text = " ".join(random.Random(1).choices(["aa", "b", "ccc", "Dd"], k=500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_groups_equal_brute_force(spark, docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(0, 120))
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 1, ""), (None, rows[0][1]), (None, "quite alone here and there"), (3, rows[3][1])]
    rng.shuffle(rows)
    expected = sorted(
        zip([r[0] for r in rows], plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]), strict=True),
        key=str,
    )
    got = simhash.near_groups(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == expected


@pytest.mark.parametrize("plain_pairs", [0, 1 << 14])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, plain_pairs):
    monkeypatch.setattr(simhash, "PLAIN_PAIRS", plain_pairs)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 6), replace=False).tolist()
            fps.add(c ^ sum(1 << b for b in flips))
    fps = np.array(sorted(fps), np.uint64)
    keys, own, entry = (np.concatenate(x) for x in zip(*((k, f, np.full(len(f), bool(e))) for k, f, e in simhash._probes(fps, 3, 1))))
    order = np.argsort(keys, kind="stable")
    forest = simhash._Forest()
    simhash._link_group(keys[order], own[order], entry[order], 4, forest)
    assert all(np.bitwise_count(np.uint64(a) ^ np.uint64(b)) <= 4 for a, b in forest.links)
    assert len(forest.links) < len(fps)
    places = {f: i for i, f in enumerate(fps.tolist())}
    labels = plain_components(list(range(len(fps))), fps)
    groups = {}
    for f, label in zip(fps.tolist(), labels, strict=True):
        groups.setdefault(label, set()).add(forest.root(f))
    assert all(len(roots) == 1 for roots in groups.values())
    assert len({next(iter(r)) for r in groups.values()}) == len(groups)
    assert len(places) == len(fps)


def connected(pairs):
    """Least member per node, of links."""
    label = {}
    for a, b in pairs:
        for x in (a, b):
            label.setdefault(x, x)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {x: root(x) for x in label}


@pytest.mark.parametrize("block", [3, 50, 1 << 16])
def test_one_segment_value_in_all_fingerprints(spark, monkeypatch, block):
    """The lowest 21 bits are the same in 300 of 400 rows, so every block of a hot value meets every piece."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # keys go on over several batches
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for i in range(400):
        fp = int(base[i % 40]) ^ sum(1 << int(b) for b in rng.choice(np.arange(21, 63), i % 6, replace=False))
        fps.add(fp >> 21 << 21 | 0x1234 if i < 300 else fp)
    fps = sorted(fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    try:
        got = [tuple(r) for r in simhash.links(distinct, len(fps)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(min(p), max(p)) for p in got} <= set(near)
    assert connected(got) == connected(near)


def test_every_entry_meets_every_row_of_a_hot_value_once():
    fps = np.arange(200, dtype=np.uint64) << np.uint64(21)
    heavy = (np.array([0], np.uint64), np.array([4]), np.array([3]))
    slots = {}
    for _, slot, own, entry in simhash._dealt(np.zeros(200, np.uint64), fps, 1, heavy):
        for s, f in zip(slot.tolist(), own.tolist(), strict=True):
            slots.setdefault(s, ([], []))[not entry].append(f)
    met = [(a, b) for entries, rows in slots.values() for a in entries for b in rows]
    assert len(met) == len(set(met)) == 200 * 200
    assert max(len(e) for e, _ in slots.values()) < 100


def test_components_around_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr("gridcast.llm.common.HEAVY_ROWS", 10)
    edges = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(40, 90)] + [(1000, 1001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == connected(edges)


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100, 102: 100}


def test_representatives_keep_columns_and_one_row_per_group(docs_of):
    long = " ".join(f"t{i}" for i in range(80))
    docs = docs_of([(4, long, "en", "s"), (9, long + " end", "de", None), (2, "some other text of its own", "fr", "q")])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in plain_components([4, 9, 2], [plain_fingerprint(r.text) for r in docs.collect()])})


def test_empty_table(docs_of):
    assert simhash.near_groups(docs_of([])).count() == 0
