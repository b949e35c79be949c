"""Windows, fills, positions, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators.folds import holdout_split, stride_sample, walk_forward
from gridcast.operators.ordered import fill_gaps, ordered_index, with_windows
from gridcast.operators.windows import lag_columns, with_rolling
from gridcast.schemas import LAG_ROWS, ROLLING_ROWS
from queries.inputs import EVENTS, HOURLY, KEYS, events, hourly, table
from queries.registry import query, r6

OVER = "OVER (PARTITION BY event_type ORDER BY datetime{0})"
# Chunks small enough that the test tables fill several of them.
ORDERED = {"strategy": "ordered", "chunk_rows": 400}


def lag_sql(column: str, prefix: str, rows=LAG_ROWS) -> str:
    over = OVER.format("")
    return ", ".join(f"{r6(f'lag({column}, {n}) {over}')} AS {prefix}_lag_{label}" for label, n in rows.items())


def rolling_sql(function: str, stat: str, column: str = "speed", prefix: str = "wind_speed") -> str:
    parts = []
    for label, n in ROLLING_ROWS.items():
        over = OVER.format(f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
        parts.append(f"{r6(f'{function}({column}) {over}')} AS {prefix}_roll_{stat}_{label}")
    return ", ".join(parts)


LAGS = f"WITH {HOURLY} SELECT event_type, datetime, {lag_sql('speed', 'wind_speed')} FROM hourly"


def lags(spark, sf_dir, **options):
    return with_windows(
        hourly(spark, sf_dir),
        KEYS,
        ["datetime"],
        48,
        lambda df, w: df.withColumns(lag_columns(w, "speed", "wind_speed", LAG_ROWS)),
        unique=True,  # one row per hour
        **options,
    ).drop("speed", "n")


@query("lag_features", LAGS)
def lag_features(spark, sf_dir):
    return lags(spark, sf_dir)


@query("lag_features_ordered", LAGS)
def lag_features_ordered(spark, sf_dir):
    return lags(spark, sf_dir, **ORDERED)


def rolling(spark, sf_dir, stat, **options):
    df = with_windows(
        hourly(spark, sf_dir),
        KEYS,
        ["datetime"],
        95,
        lambda df, w: with_rolling(df, w, "speed", "wind_speed", ROLLING_ROWS, [stat]),
        unique=True,
        **options,
    )
    return df.drop("speed", "n")


MEANS = f"WITH {HOURLY} SELECT event_type, datetime, {rolling_sql('avg', 'mean')} FROM hourly"
DEVIATIONS = f"WITH {HOURLY} SELECT event_type, datetime, {rolling_sql('stddev_samp', 'std')} FROM hourly"


@query("rolling_mean", MEANS)
def rolling_mean(spark, sf_dir):
    return rolling(spark, sf_dir, "mean")


@query("rolling_mean_ordered", MEANS)
def rolling_mean_ordered(spark, sf_dir):
    return rolling(spark, sf_dir, "mean", **ORDERED)


@query("rolling_std", DEVIATIONS)
def rolling_std(spark, sf_dir):
    return rolling(spark, sf_dir, "std")


@query("rolling_std_ordered", DEVIATIONS)
def rolling_std_ordered(spark, sf_dir):
    return rolling(spark, sf_dir, "std", **ORDERED)


FILLED = f"""WITH {HOURLY}, holes AS (SELECT event_type, datetime, CASE WHEN n >= 3 THEN speed END AS speed FROM hourly)
    SELECT event_type, datetime, {r6('''coalesce(
      last_value(speed IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(speed IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS speed
    FROM holes"""


def filled(spark, sf_dir, **options):
    holes = hourly(spark, sf_dir).select(
        "event_type", "datetime", F.when(F.col("n") >= 3, F.col("speed")).alias("speed")
    )
    return fill_gaps(holes, KEYS, ["datetime"], ["speed"], unique=True, **options)


@query("fill_forward_back", FILLED)
def fill_forward_back(spark, sf_dir):
    return filled(spark, sf_dir)


@query("fill_forward_back_ordered", FILLED)
def fill_forward_back_ordered(spark, sf_dir):
    return filled(spark, sf_dir, strategy="ordered", chunk_rows=50)


ORDER = ["datetime", "event_id"]
NUMBERED = f"{EVENTS}, numbered AS (SELECT *, row_number() OVER (ORDER BY datetime, event_id) - 1 AS r, count(*) OVER () AS n FROM events_)"


@query("ordered_index", f"WITH {NUMBERED} SELECT event_id, datetime, CAST(r AS BIGINT) AS row FROM numbered")
def index_of_events(spark, sf_dir):
    return ordered_index(events(spark, sf_dir).select("event_id", "datetime"), ORDER, unique=True)


@query(
    "stride_sample",
    f"""WITH {NUMBERED}, stepped AS (SELECT *, greatest(1, n // 8) AS k FROM numbered)
        SELECT event_id, datetime, {r6('value')} AS value, CAST(r AS BIGINT) AS row FROM stepped WHERE r % k = 0 AND r < 8 * k""",
)
def sample_of_events(spark, sf_dir):
    return stride_sample(events(spark, sf_dir).select("event_id", "datetime", "value"), ORDER)


@query(
    "sorted_output",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, {r6('l_extendedprice')} AS l_extendedprice FROM lineitem",
)
def sorted_output(spark, sf_dir):
    chosen = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    return table(spark, sf_dir, "lineitem").select(*chosen).orderBy("l_shipdate", "l_orderkey", "l_linenumber")


@query(
    "walk_forward",
    f"""WITH {NUMBERED}, folds AS (SELECT unnest(range(1, 6)) AS fold),
          sized AS (SELECT *, CAST(floor(n * 0.15) AS BIGINT) AS t FROM numbered),
          placed AS (SELECT event_id, r, fold, n - (6 - fold) * t AS start_, t FROM sized CROSS JOIN folds)
        SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN r < start_ - 24 THEN 'train' ELSE 'test' END AS role,
               CAST(r AS BIGINT) AS row, event_id
        FROM placed WHERE r < start_ - 24 OR (r >= start_ AND r < start_ + t)""",
)
def walk_forward_events(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "datetime")
    return walk_forward(df, ORDER, n_splits=5, fraction=0.15, gap=24).drop("datetime")


@query(
    "holdout_split",
    f"""WITH {NUMBERED} SELECT event_id, datetime, CASE WHEN r >= n - 48 THEN 'holdout' ELSE 'train' END AS role
        FROM numbered""",
)
def holdout_of_events(spark, sf_dir):
    return holdout_split(events(spark, sf_dir).select("event_id", "datetime"), ORDER, 48)
