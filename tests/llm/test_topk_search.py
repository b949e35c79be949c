from __future__ import annotations

import math

import numpy as np
import pytest
from gridcast.llm import topk_search as t
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def plain(rows, k=5, every=50):
    good = []
    for vec_id, vector in rows:
        if vec_id is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            good.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, every=50):
    df = spark.createDataFrame([(i, v, 0, 7, 7) for i, v in rows], SCHEMA)
    return sorted(map(tuple, t.top_k(df, F.col("vec_id") % every == 0).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many shards, leaves, blocks and salted cells
        for name, value in (("SHARD_ROWS", 40), ("LEAF_ROWS", 4), ("BLOCK_QUERIES", 7), ("SAMPLE_ROWS", 60)):
            monkeypatch.setattr(t, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(150)]  # one very common vector
    rows += [(None, [1.0] * 6), (50, None), (1000, [1.0, None] * 3), (1050, [math.nan] * 6), (1100, [math.inf] * 6)]
    rows += [(100, rows[100][1]), (7, rows[7][1]), (1150, [1.0, 2.0]), (1151, [3.0, -2.0]), (1200, [])]
    rows += [(1250, [9e6, -9e6]), (1300, [0.0] * 6)]
    assert run(spark, rows, every=25) == plain(rows, every=25)


def test_few_and_no_candidates(spark):
    assert run(spark, [(50, [1.0, 1.0])]) == []
    assert run(spark, [(50, [1.0, 1.0]), (3, [2.0, 0.0])]) == [(50, 1, 3, 131072)]
    assert run(spark, []) == []


def test_search_skips_boxes_below_the_kth_score():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(-10, 10, (500, 4)), rng.integers(900, 1000, (500, 4))]).astype(float)
    tree = t.Tree(vectors, np.arange(1000), leaf=16)
    reads = []
    held = tree.vectors

    class Counted:
        def __getitem__(self, key):
            reads.append(key)
            return held[key]

    tree.vectors = Counted()
    best = tree.search(np.array([1.0, 2.0, 3.0, 4.0]), -1, 5, None)
    scores = vectors @ np.array([1.0, 2.0, 3.0, 4.0])
    assert [-s for s, _ in best] == sorted(scores.astype(int).tolist(), reverse=True)[:5]
    assert len(reads) < 40


def test_rows_are_dealt_to_the_blocks_that_ask_them(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_QUERIES", 3)
    asked = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 7)], "shard string, row long")
    held = spark.createDataFrame([(s, i) for s in "abcd" for i in range(10)], "shard string, vec_id long")
    own, dealt = t.in_blocks(asked, held)
    copies = {(r.shard, r.vec_id): r["count"] for r in dealt.groupBy("shard", "vec_id").count().collect()}
    assert copies == {**{("a", i): 3 for i in range(10)}, **{("b", i): 1 for i in range(10)}}  # c and d are not asked
    assert own.count() == 8 and own.join(dealt, ["shard", "block"], "left_anti").isEmpty()
