from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gridcast.llm import common, prefix_trie
from gridcast.llm.prefix_trie import numbered_turns, op11_prefix_trie, prefix_trie as build, regrown

ROWS = "conv_id long, turn long, role string, text string, node string"


def words(text):
    return len([w for w in text.encode().split() if w])


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def brute_force(rows):
    members = defaultdict(list)
    for c, path in rebuilt(rows).items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path)))
    children = defaultdict(set)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].add(prefix)
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix in members:
        own = (len(members[prefix]) - 1) * words(prefix[-1][1]) if prefix else 0
        for d in range(len(prefix) + 1):
            saved[prefix[:d]] += own
            leaves[prefix[:d]] += not children[prefix]
    out = []
    for prefix, who in members.items():
        ends = ",".join(str(c) for c, n in sorted(who) if n == len(prefix))
        parent = min(members[prefix[:-1]])[0] if prefix else None
        out.append((min(who)[0], len(prefix), parent, len(who), len(children[prefix]), leaves[prefix], saved[prefix],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ROWS)


def random_rows(count, longest, seed, alphabet=3):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, count):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choice("abc"[:alphabet]) for _ in range(2))))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark, written):
    rows = random_rows(60, 6, 1)
    folder = written(conversations=conversations(spark, rows))
    assert result(op11_prefix_trie(spark, folder)) == brute_force(rows)


@pytest.mark.parametrize("band", [2, 3])
def test_depth_of_many_bands(spark, band):
    rows = random_rows(8, 20, 2, alphabet=1) + [(100, t, "user", "long way") for t in range(70)]
    convs, turns = regrown(numbered_turns(conversations(spark, rows)), 20, 3)
    assert result(build(convs, turns, band)) == brute_force(rows)


def test_nulls_empty_texts_ties_and_turnless_conversations(spark):
    rows = [
        (None, 0, "user", "nobody"),
        (0, None, "user", "first by null"), (0, 0, None, None), (0, 0, "user", ""), (0, 0, "user", ""), (0, 1, "user", "x " * 5000),
        *((c, 0, None, "") for c in range(41, 60)),  # their base is absent: those with h > 0 lose their turn
        (20, 3, "a", "b"), (21, 5, "a", "b"), (22, 5, "a", "b"),
    ]
    convs, turns = regrown(numbered_turns(conversations(spark, rows)), 20, 3)
    assert result(build(convs, turns)) == brute_force(rows)


def test_empty_table(spark):
    convs, turns = regrown(numbered_turns(conversations(spark, [])), 20, 3)
    assert result(build(convs, turns)) == []


def test_only_turnless(spark):
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "gone")]
    convs, turns = regrown(numbered_turns(conversations(spark, rows)), 20, 3)
    got = result(build(convs, turns))
    assert got == brute_force(rows) and got[0][5] == 1


def test_conversation_too_long_for_one_task_and_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    monkeypatch.setattr(common, "HEAVY_KEYS", 10)
    rows = random_rows(20, 4, 3) + [(7000, t, "user", f"turn {t % 3}") for t in range(150)]
    convs, turns = regrown(numbered_turns(conversations(spark, rows), max_group_rows=10), 20, 3)
    assert result(build(convs, turns)) == brute_force(rows)


def test_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(-60, 60)]
    convs, turns = regrown(numbered_turns(conversations(spark, rows)), 20, 3)
    assert result(build(convs, turns)) == brute_force(rows)


def test_bands_bound_what_a_row_holds(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(50)]
    _, turns = regrown(numbered_turns(conversations(spark, rows)), 20, 3)
    assert max(len(r["nodes"]) for r in prefix_trie.bands(turns, 4).collect()) == 4
