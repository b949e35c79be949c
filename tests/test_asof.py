from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from plans import plan

from gridcast.operators.asof import nearest_join, pick_join_strategy

T0 = datetime(2024, 1, 1)
STRATEGIES = [
    {"strategy": "series"},
    {"strategy": "bucket"},
    {"strategy": "ordered", "chunk_rows": 6},
    {"strategy": "ordered", "chunk_rows": 200},
]


def minutes(n: float) -> datetime:
    return T0 + timedelta(minutes=n)


def frames(spark, left, right):
    lefts = spark.createDataFrame(
        [(k, minutes(m), i) for i, (k, m) in enumerate(left)], "key STRING, datetime TIMESTAMP, id INT"
    )
    rights = spark.createDataFrame(
        [(k, minutes(m), i, v) for i, (k, m, v) in enumerate(right)],
        "key STRING, datetime TIMESTAMP, seq INT, value DOUBLE",
    )
    return lefts.repartition(3), rights.repartition(3)


def joined(left, right, **options) -> dict[int, float | None]:
    df = nearest_join(left, right, keys=["key"], right_order=["seq"], values=["value"], **options)
    assert df.columns == ["key", "datetime", "id", "value"]
    return {r.id: r.value for r in df.collect()}


@pytest.mark.parametrize("options", STRATEGIES)
def test_edges(spark, options):
    left = [("a", 0), ("a", 100), ("a", 200), ("a", 300), ("a", 400), ("b", 0), ("c", 0)]
    right = [
        ("a", 0, 1.0),  # exact
        ("a", 70, 2.0),  # 30 behind and
        ("a", 130, 3.0),  # 30 ahead: the earlier one wins
        ("a", 169, 4.0),  # 31 away
        ("a", 290, 5.0),
        ("a", 290, 6.0),  # behind: the last of equals
        ("a", 410, 7.0),
        ("a", 410, 8.0),  # ahead: the first of equals
        ("b", -30, 9.0),  # the tolerance is inclusive
    ]
    assert joined(*frames(spark, left, right), **options) == {
        0: 1.0, 1: 2.0, 2: None, 3: 6.0, 4: 7.0, 5: 9.0, 6: None,
    }


@pytest.mark.parametrize("options", STRATEGIES)
def test_no_right_rows(spark, options):
    left, right = frames(spark, [("a", 0), ("b", 5)], [])
    assert joined(left, right, **options) == {0: None, 1: None}
    assert joined(left.limit(0), right, **options) == {}


@pytest.mark.parametrize("options", STRATEGIES)
@pytest.mark.parametrize("seed", [11, 12])
def test_equals_pandas(spark, options, seed):
    random_ = random.Random(seed)
    span = 6000
    left = [(random_.choice("aab"), random_.randrange(span)) for _ in range(400)]
    right = [(random_.choice("aab"), random_.randrange(0, span, 5), float(i)) for i in range(250)]
    lefts = pd.DataFrame(left, columns=["key", "m"]).reset_index(names="id").sort_values(["m", "id"])
    rights = pd.DataFrame(right, columns=["key", "m", "value"]).sort_values("m", kind="stable")
    expected = pd.merge_asof(lefts, rights, on="m", by="key", direction="nearest", tolerance=30)
    assert expected["value"].isna().any()
    got = joined(*frames(spark, left, right), **options)
    assert got == {r.id: None if pd.isna(r.value) else r.value for r in expected.itertuples()}


@pytest.mark.parametrize("options", STRATEGIES)
def test_equals_brute_force_in_one_crowded_moment(spark, options):
    left = [("a", i / 60 / 1000) for i in range(300)]
    right = [("a", i / 60 / 999, float(i)) for i in range(300)]
    got = joined(*frames(spark, left, right), tolerance=timedelta(microseconds=500), **options)
    for i, (_, m) in enumerate(left):
        at = minutes(m)
        near = [((abs(minutes(r) - at), minutes(r) > at, -j if minutes(r) <= at else j), v) for j, (_, r, v) in enumerate(right)]
        (distance, _, _), value = min(near)
        assert got[i] == (value if distance <= timedelta(microseconds=500) else None)


def test_auto_follows_the_sizes(spark):
    left, right = frames(spark, [("a", i) for i in range(50)], [("a", i * 60, 1.0) for i in range(600)])
    assert pick_join_strategy(left, right, keys=["key"], max_group_rows=1000) == "series"
    assert pick_join_strategy(left, right, keys=["key"], max_group_rows=100) == "bucket"
    assert pick_join_strategy(left, right, keys=["key"], max_group_rows=10) == "ordered"


def test_no_pairs_are_formed(spark):
    left, right = frames(spark, [("a", 0)], [("a", 0, 1.0)])
    for options in STRATEGIES:
        text = plan(nearest_join(left, right, keys=["key"], values=["value"], **options))
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" not in text
        assert "SinglePartition" not in text


def test_series_plan_shuffles_once(spark):
    left, right = frames(spark, [("a", 0)], [("a", 0, 1.0)])
    text = plan(nearest_join(left, right, keys=["key"], values=["value"], strategy="series"))
    assert text.count("Exchange hashpartitioning(key") == 1


def test_clashing_columns_are_refused(spark):
    left, right = frames(spark, [("a", 0)], [("a", 0, 1.0)])
    with pytest.raises(ValueError, match="both sides"):
        nearest_join(left.withColumnRenamed("id", "value"), right, keys=["key"])
