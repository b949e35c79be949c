"""Helper columns never meet a caller's: frames with their very names come back as they were."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridcast.operators.asof import nearest_join
from gridcast.operators.folds import holdout_split, rows_at, stride_sample
from gridcast.operators.ordered import carry, fill_gaps, ordered_rows, with_windows

NAMES = ["_tie", "_row", "_chunk", "_place", "_side", "_part", "_start", "_entry", "_before", "_after", "_match", "_bucket", "_bin", "_ahead_x"]
T0 = datetime(2024, 1, 1)
STRATEGIES = [{"strategy": "series"}, {"strategy": "ordered", "chunk_rows": 7}]


@pytest.fixture
def df(spark):
    rows = [(k, T0 + timedelta(hours=h), float(h) if h % 3 else None, *range(100, 100 + len(NAMES))) for k in ("a", "b") for h in range(20)]
    return spark.createDataFrame(rows, "key string, ts timestamp, x double, " + ", ".join(f"{n} int" for n in NAMES))


def unharmed(out, df):
    assert set(df.columns) <= set(out.columns)
    assert out.select(*df.columns).schema == df.schema
    held = out.select(*NAMES).distinct().collect()
    assert [tuple(r) for r in held] == [tuple(range(100, 100 + len(NAMES)))]


@pytest.mark.parametrize("options", STRATEGIES)
@pytest.mark.parametrize("unique", [True, False])
def test_windows_fills_and_carries(df, options, unique):
    shifted = with_windows(df, ["key"], ["ts"], 2, lambda d, w: d.withColumn("lag", F.lag("x", 2).over(w)), unique=unique, **options)
    unharmed(shifted, df)
    assert shifted.columns == [*df.columns, "lag"]
    filled = fill_gaps(df, ["key"], ["ts"], ["x"], unique=unique, **options)
    assert filled.columns == df.columns and filled.where("x IS NULL").isEmpty()
    unharmed(filled, df)
    unharmed(carry(df, ["key"], ["ts"], {"before": "x"}, {"after": "x"}, unique=unique, **options), df)


@pytest.mark.parametrize("options", [*STRATEGIES, {"strategy": "bucket"}])
def test_nearest_join(df, options):
    right = df.select("key", "ts", F.col("x").alias("value"), *(F.lit(7).alias(n) for n in NAMES[:1]))
    joined = nearest_join(df, right, "ts", ["key"], values=["value"], **options)
    assert joined.columns == [*df.columns, "value"] and joined.where("NOT (value <=> x)").isEmpty()
    unharmed(joined, df)


def test_positions_splits_and_samples(df):
    unharmed(ordered_rows(df, ["ts", "key"]).df, df)
    split = holdout_split(df, ["ts", "key"], 5)
    unharmed(split, df)
    assert split.where("role = 'holdout'").count() == 5
    unharmed(stride_sample(df, ["ts", "key"]), df)
    unharmed(rows_at(df, ["ts"], [0, 39], most=1), df)
