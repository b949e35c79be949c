from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from plans import plan
from pyspark.sql import functions as F

from gridcast.operators import folds
from gridcast.operators.ordered import (
    carry,
    fill_gaps,
    largest_group,
    ordered_index,
    ordered_rows,
    running_sums,
    with_windows,
)
from gridcast.operators.windows import lag_columns, with_rolling

START = datetime(2024, 1, 1)
STRATEGIES = [{"strategy": "series"}, {"strategy": "ordered", "chunk_rows": 7}, {"strategy": "ordered", "chunk_rows": 50}]


def series(seed: int, rows: int = 300, nulls: float = 0.2) -> pd.DataFrame:
    """Three hourly series with gaps and missing values, one of them holding most of the rows."""
    random_ = random.Random(seed)
    times = {"a": START, "b": START, "c": START}
    out = []
    for i in range(rows):
        key = random_.choices(["a", "b", "c"], [8, 1, 1])[0]
        times[key] += timedelta(hours=random_.choice([1, 1, 1, 2, 7]))
        value = None if random_.random() < nulls else round(random_.uniform(-5, 20), 2)
        out.append((key, times[key], i, value))
    return pd.DataFrame(out, columns=["key", "ts", "id", "x"])


def spark_frame(spark, frame: pd.DataFrame):
    rows = [(r.key, r.ts.to_pydatetime(), r.id, None if pd.isna(r.x) else r.x) for r in frame.itertuples()]
    return spark.createDataFrame(rows, "key STRING, ts TIMESTAMP, id INT, x DOUBLE").repartition(5)


def shifted(df, window):
    return df.withColumn("y", F.lag("x").over(window))


def result(df, *columns) -> pd.DataFrame:
    rows = df.select("id", *columns).orderBy("id").collect()
    return pd.DataFrame([r.asDict() for r in rows], columns=["id", *columns]).astype(float)


@pytest.mark.parametrize("options", STRATEGIES)
@pytest.mark.parametrize("seed", [1, 2])
def test_lag_and_rolling_equal_pandas(spark, options, seed):
    frame = series(seed)
    steps = {"1": 1, "2": 2, "5": 5, "6": 6}
    df = with_windows(
        spark_frame(spark, frame),
        ["key"],
        ["ts"],
        5,
        lambda df, w: with_rolling(
            df.withColumns(lag_columns(w, "x", "x", {"1": 1, "5": 5})), w, "x", "x", steps
        ),
        **options,
    )
    groups = frame.groupby("key")["x"]
    expected = pd.DataFrame({"id": frame["id"]})
    for n in (1, 5):
        expected[f"x_lag_{n}"] = groups.shift(n)
    for n in (1, 2, 5, 6):
        rolling = groups.rolling(n, min_periods=1)
        expected[f"x_roll_mean_{n}"] = rolling.mean().reset_index(level=0, drop=True)
        expected[f"x_roll_std_{n}"] = rolling.std().reset_index(level=0, drop=True)
    got = result(df, *expected.columns[1:])
    pd.testing.assert_frame_equal(got, expected.sort_values("id").reset_index(drop=True).astype(float), atol=1e-6)


@pytest.mark.parametrize("options", STRATEGIES)
@pytest.mark.parametrize("nulls", [0.2, 0.9, 1.0])
def test_fill_equals_pandas(spark, options, nulls):
    frame = series(3, 200, nulls)
    got = result(fill_gaps(spark_frame(spark, frame), ["key"], ["ts"], ["x"], **options), "x")
    filled = frame.groupby("key")["x"].transform(lambda x: x.astype(float).ffill().bfill())
    expected = pd.DataFrame({"id": frame["id"].astype(float), "x": filled.astype(float)})
    pd.testing.assert_frame_equal(got, expected)


@pytest.mark.parametrize("options", STRATEGIES)
def test_carry_looks_both_ways(spark, options):
    frame = series(4, 150, 0.7)
    df = carry(spark_frame(spark, frame), ["key"], ["ts"], {"before": "x"}, {"after": "x"}, **options)
    groups = frame.groupby("key")["x"]
    expected = pd.DataFrame(
        {"id": frame["id"], "before": groups.ffill(), "after": groups.bfill()}
    ).astype(float)
    pd.testing.assert_frame_equal(result(df, "before", "after"), expected)


@pytest.mark.parametrize("options", STRATEGIES)
def test_null_key_is_a_series_of_its_own(spark, options):
    rows = [(None, START + timedelta(hours=i), i, float(i) if i == 5 else None) for i in range(20)]
    rows += [("a", START + timedelta(hours=i), 20 + i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "key STRING, ts TIMESTAMP, id INT, x DOUBLE")
    got = fill_gaps(df, ["key"], ["ts"], ["x"], **options)
    assert {(r.key, r.x) for r in got.collect()} == {(None, 5.0), ("a", None)}


def test_index_is_the_sorted_position(spark):
    frame = series(5, 400)
    rows = ordered_rows(spark_frame(spark, frame), ["ts", "id"])
    expected = frame.sort_values(["ts", "id"])["id"].tolist()
    assert rows.total == 400
    assert [r.id for r in rows.df.orderBy("row").collect()] == expected
    assert [r.row for r in rows.df.select("row").orderBy("row").collect()] == list(range(400))


def test_index_splits_a_timestamp_that_holds_all_rows(spark):
    df = spark.range(4000).select(F.lit(START).alias("ts"), "id")
    rows = ordered_index(df, ["ts", "id"])
    assert rows.where("row <> id").isEmpty()
    spread = ordered_index(df, ["ts", "id"], "row").withColumn("part", F.expr("row DIV 1000"))
    assert spread.groupBy("part").count().count() == 4


def test_ties_are_numbered_the_same_every_time(spark):
    df = spark.range(500).select(F.lit(START).alias("ts"), (F.col("id") * 7919 % 500).alias("x"))
    runs = [ordered_index(df.repartition(n), ["ts"]).orderBy("row").collect() for n in (2, 7)]
    assert runs[0] == runs[1]


def test_empty_input(spark):
    df = spark.createDataFrame([], "key STRING, ts TIMESTAMP, id INT, x DOUBLE")
    assert ordered_rows(df, ["ts"]).total == 0
    assert largest_group(df, ["key"]) == 0
    for options in STRATEGIES:
        assert fill_gaps(df, ["key"], ["ts"], ["x"], **options).isEmpty()
        assert with_windows(df, ["key"], ["ts"], 5, shifted, **options).isEmpty()


def test_auto_measures_the_largest_series(spark):
    frame = series(6)
    df = spark_frame(spark, frame)
    assert largest_group(df, ["key"]) == frame.groupby("key").size().max()
    wide = with_windows(df, ["key"], ["ts"], 1, shifted, max_group_rows=1000)
    cut = with_windows(df, ["key"], ["ts"], 1, shifted, max_group_rows=10, chunk_rows=20)
    assert "_chunk" not in plan(wide) and "_chunk" in plan(cut)


def test_chunk_has_to_hold_the_reach(spark):
    df = spark_frame(spark, series(7, 20))
    with pytest.raises(ValueError, match="smaller than reach"):
        with_windows(df, [], ["ts"], 9, shifted, strategy="ordered", chunk_rows=8)


def test_ordered_plans_use_no_single_partition(spark):
    df = spark_frame(spark, series(8))
    options = {"strategy": "ordered", "chunk_rows": 20}
    plans = [
        plan(with_windows(df, [], ["ts", "id"], 5, shifted, **options)),
        plan(with_windows(df, ["key"], ["ts"], 5, shifted, **options)),
        plan(ordered_index(df, ["ts", "id"])),
        plan(fill_gaps(df, ["key"], ["ts"], ["x"], **options)),
    ]
    for text in plans:
        assert "SinglePartition" not in text
        assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("chunk_rows", [1, 7, 50, 1000])
@pytest.mark.parametrize("nulls", [0.0, 0.5, 1.0])
def test_running_sums_look_both_ways(spark, chunk_rows, nulls):
    frame = series(9, 120, nulls)
    whole = [None if pd.isna(x) else round(x * 100) for x in frame["x"]]
    rows = [(None if i == 0 else i, x) for i, x in enumerate(whole)]  # the order of one row is NULL: it comes first
    df = spark.createDataFrame(rows, "id INT, x LONG").repartition(5)
    got = running_sums(df, ["id"], "x", "upto", "after", chunk_rows=chunk_rows, unique=True)
    assert got.columns == ["id", "x", "upto", "after"]

    def total(values):
        known = [v for v in values if v is not None]
        return sum(known) if known else None

    expected = {(i, x, total(whole[: n + 1]), total(whole[n + 1 :])) for n, (i, x) in enumerate(rows)}
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(rows)
    assert running_sums(df.limit(0), ["id"], "x", "upto", "after").isEmpty()


def test_running_sums_gather_one_row_per_chunk(spark):
    df = spark_frame(spark, series(8)).select("id", "x", F.lit(1).alias("_chunk"))  # a caller's column of that name
    text = plan(running_sums(df, ["id"], "x", "upto", "after", chunk_rows=20, unique=True))
    assert "unboundedfollowing" not in text
    lines = text.splitlines()
    gathered = [n for n, line in enumerate(lines) if "SinglePartition" in line]
    assert gathered and all("HashAggregate(keys=[__chunk" in lines[n + 1] for n in gathered)


# --- positions without a sort ---------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 3, 1000])
@pytest.mark.parametrize("bins", [2, 4096])
def test_rows_at_positions_equal_the_sorted_ones(spark, monkeypatch, most, bins):
    monkeypatch.setattr(folds, "BINS", bins)
    rng = random.Random(most)
    times = [datetime(2024, 1, 1) + timedelta(seconds=rng.choice([0, 0, 0, 1, 5, 10**6])) for _ in range(60)]
    rows = [(t, i % 7, i) for i, t in enumerate(times)] + [(None, i, 100 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, a int, id int").repartition(3)
    positions = [0, 3, 4, 5, 6, 30, 31, 64, 65, 900]
    got = {r.row: (r.ts, r.a) for r in folds.rows_at(df, ["ts", "a"], positions, most).collect()}
    whole = sorted(((t, a) for t, a, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {p: whole[p] for p in positions if p < len(whole)}
    # The same rows whichever way: ties follow the hash that the full numbering takes.
    numbered = {r.row: r.id for r in ordered_rows(df, ["ts", "a"]).df.collect()}
    assert {r.row: r.id for r in folds.rows_at(df, ["ts", "a"], positions, most).collect()} == {p: numbered[p] for p in got}


@pytest.mark.parametrize("kind", ["bigint", "date", "string", "timestamp_ntz"])
def test_rows_at_other_orders(spark, kind):
    df = spark.range(50).select(F.expr(f"CAST({'id' if kind in ('bigint', 'string') else 'date_add(date' + chr(39) + '2024-01-01' + chr(39) + ', CAST(id AS INT))'} AS {kind})").alias("k"))
    whole = sorted(r.k for r in df.collect())
    assert {r.row: r.k for r in folds.rows_at(df, ["k"], [0, 7, 49], most=4).collect()} == {p: whole[p] for p in (0, 7, 49)}
    assert folds.rows_at(df, ["k"], []).isEmpty() and folds.rows_at(df.limit(0), ["k"], [0]).isEmpty()


def test_sample_plan_has_no_full_sort(spark):
    df = spark.range(20000).select(F.expr("timestamp_seconds(id * 60)").alias("ts"), "id")
    text = plan(folds.stride_sample(df, ["ts", "id"], 8))
    assert "rangepartitioning" not in text
    assert folds.stride_sample(df, ["ts", "id"], 8).count() == 8
