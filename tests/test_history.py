from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridcast.operators.dedupe import keep_first, keep_last
from gridcast.plans import history
from gridcast.plans.nightly import Tables, extend_history
from gridcast.sources import store as store_module
from gridcast.sources.store import Store
from gridcast.sources.tables import write_table
from gridcast.streaming.history import append_unique, read_stream, stream_upsert

SCHEMA = "datetime TIMESTAMP, x DOUBLE, seq INT"
T0 = datetime(2024, 1, 30)


def frame(spark, *rows):
    return spark.createDataFrame([(T0 + timedelta(hours=h), float(x), i) for i, (h, x) in enumerate(rows)], SCHEMA)


def content(df) -> dict:
    rows = df.collect()
    found = {int((r.datetime - T0).total_seconds() // 3600): r.x for r in rows}
    assert len(found) == len(rows)
    return found


def test_keep_first_and_last(spark):
    df = frame(spark, (0, 1), (1, 2), (0, 3), (0, 4)).repartition(3)
    assert content(keep_first(df, ["datetime"], ["seq"])) == {0: 1.0, 1: 2.0}
    assert content(keep_last(df, ["datetime"], ["seq"])) == {0: 4.0, 1: 2.0}
    assert keep_last(df, ["datetime"], ["seq"]).columns == df.columns
    assert keep_first(df.select("datetime"), ["datetime"], ["datetime"]).count() == 2


def test_kept_row_may_hold_nulls(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5.0, 0)], "k INT, x DOUBLE, seq INT")
    assert keep_last(df, ["k"], ["seq"]).first().x is None


def test_upsert(spark):
    old, new = frame(spark, (0, 1), (1, 2)), frame(spark, (1, 20), (2, 30), (2, 31))
    merged = history.upsert(old, new, order=["seq"])
    assert content(merged) == {0: 1.0, 1: 20.0, 2: 31.0}
    assert content(history.upsert(merged, new, order=["seq"])) == content(merged)
    assert content(history.upsert(old, new.limit(0))) == {0: 1.0, 1: 2.0}
    assert content(history.upsert(old.limit(0), new, order=["seq"])) == {1: 20.0, 2: 31.0}


def test_forecast_weather_wins(spark):
    past, ahead = frame(spark, (0, 1), (1, 2)), frame(spark, (1, 20), (2, 30))
    assert content(history.assemble_weather(past, ahead)) == {0: 1.0, 1: 20.0, 2: 30.0}


def test_resolve_history(spark):
    long, short, new = frame(spark, (0, 1), (1, 2)), frame(spark, (0, 9)), frame(spark, (5, 5))
    assert history.resolve_history(long, short, new) is long
    assert history.resolve_history(long, long, new) is long
    assert history.resolve_history(short, long, new) is long
    assert history.resolve_history(None, long, new) is long
    assert history.resolve_history(None, None, new) is new
    assert history.resolve_history(short, None, new) is short


def stored(spark, path):
    return history.read_history(spark, str(path))


def test_upsert_table_rewrites_only_touched_months(spark, tmp_path):
    path = tmp_path / "history"
    history.upsert_table(spark, str(path), frame(spark, (0, 1), (24, 2), (72, 3)), order=["seq"])
    january = [p for p in Store(spark, str(path)).parts(history.ROWS) if p.month == 1]
    history.upsert_table(spark, str(path), frame(spark, (72, 30), (73, 40)), order=["seq"])
    assert content(stored(spark, path)) == {0: 1.0, 24: 2.0, 72: 30.0, 73: 40.0}
    assert [p for p in Store(spark, str(path)).parts(history.ROWS) if p.month == 1] == january
    history.upsert_table(spark, str(path), frame(spark), order=["seq"])
    assert len(content(stored(spark, path))) == 4


@pytest.mark.parametrize("step", ["data", "manifest"])
def test_readers_never_see_a_half_replaced_history(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "history")
    history.upsert_table(spark, path, frame(spark, (0, 1), (1, 2)), token="1")
    before = stored(spark, path)
    batch = frame(spark, (1, 20), (60, 30))  # two months

    def failing(*args, **kwargs):
        raise OSError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(Store, "_write" if step == "data" else "_switch", failing)
        with pytest.raises(OSError):
            history.upsert_table(spark, path, batch, token="2")
    assert content(stored(spark, path)) == {0: 1.0, 1: 2.0}
    for _ in range(2):  # the rerun, and a replay of it
        history.upsert_table(spark, path, batch, token="2")
        assert content(stored(spark, path)) == {0: 1.0, 1: 20.0, 60: 30.0}
    assert content(before) == {0: 1.0, 1: 2.0}  # whoever reads the version before still can
    history.upsert_table(spark, path, frame(spark, (60, 31)), token="3")
    assert content(stored(spark, path)) == {0: 1.0, 1: 20.0, 60: 31.0}


def test_history_starts_from_a_longer_snapshot(spark, tmp_path):
    tables = Tables.under(str(tmp_path))
    extend_history(spark, tables, frame(spark, (0, 1)))
    assert content(stored(spark, tables.history)) == {0: 1.0}
    write_table(frame(spark, (0, 5), (1, 6), (1, 6), (2, 7)), tables.snapshot)
    extend_history(spark, tables, frame(spark, (2, 70)))
    assert content(stored(spark, tables.history)) == {0: 5.0, 1: 6.0, 2: 70.0}


def test_stream_upsert_equals_batch(spark, tmp_path):
    landing, path, state = (str(tmp_path / n) for n in ("landed", "history", "state"))
    parts = [[(0, 1), (1, 2), (1, 3)], [(1, 20), (40, 5)], [(40, 50), (41, 6)]]
    expected = None
    for rows in parts:
        batch = frame(spark, *rows)
        batch.write.mode("append").parquet(landing)
        stream = read_stream(spark, landing, batch.schema)
        stream_upsert(stream, path, state, order=["seq"]).awaitTermination()
        expected = batch if expected is None else history.upsert(expected, batch, order=["seq"])
        assert content(stored(spark, path)) == content(history.upsert(expected, expected, order=["seq"]))
    assert content(stored(spark, path)) == {0: 1.0, 1: 20.0, 40: 50.0, 41: 6.0}
    # Nothing new has landed: nothing changes.
    stream_upsert(read_stream(spark, landing, batch.schema), path, state, order=["seq"]).awaitTermination()
    assert len(content(stored(spark, path))) == 4


def test_stream_dedupe_across_batches(spark, tmp_path):
    """Thirty days of hours in random order, every hour twice, one file per batch."""
    landing, path, state = (str(tmp_path / n) for n in ("landed", "unique", "state"))
    hours = [*range(24 * 30), *range(24 * 30)]
    random.Random(3).shuffle(hours)
    for at in range(0, len(hours), 240):
        frame(spark, *((h, h) for h in hours[at : at + 240])).coalesce(1).write.mode("append").parquet(landing)
    stream = read_stream(spark, landing, spark.read.parquet(landing).schema, files_per_batch=1)
    append_unique(stream, path, state, ["datetime"]).awaitTermination()
    assert content(stored(spark, path)) == {h: float(h) for h in range(24 * 30)}
    assert 6 <= len(Store(spark, path).parts(history.ROWS)) <= 12  # six batches over two months


def test_parts_stay_bounded_and_ruled_out_months_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MAX_PARTS", 3)
    store = Store(spark, str(tmp_path / "store"))
    for n in range(12):
        batch = frame(spark, (n, n), (n + 100, n))
        store.publish(f"t{n}", store.appended("x", store.unseen("x", batch, ["datetime"], "datetime"), ["datetime"], "datetime"))
    assert max(Counter((p.year, p.month) for p in store.parts("x")).values()) <= 3
    assert content(store.read("x")) == {h: float(h % 100) for n in range(12) for h in (n, n + 100)}
    assert store.rows("x") == 24
    read = []
    plain = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, months=None: read.append(months) or plain(self, name, months))
    new = frame(spark, (50, 1), (51, 2), (2, 9))  # the first two are in January, like 2, but unknown
    assert content(store.unseen("x", new, ["datetime"], "datetime")) == {50: 1.0, 51: 2.0}
    assert read == [[(2024, 1)]]
    read.clear()
    far = frame(spark, (150, 1), (151, 1))
    assert content(store.unseen("x", far, ["datetime"], "datetime")) == {150: 1.0, 151: 1.0}
    assert read == []  # February holds rows, and the filters rule both out


def test_filters_never_miss_a_stored_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    store.publish("1", store.appended("x", rows.where("cast(k as int) < 2000"), ["k"]))
    assert {int(r.k) for r in store.unseen("x", rows, ["k"]).collect()} == set(range(2000, 3000))
    assert store.possible("x", rows.where("cast(k as int) >= 2000"), ["k"]).count() < 60
