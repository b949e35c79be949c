"""Scans, sinks and reshaping of landed documents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.metrics import rmse
from gridcast.functions.scalars import parse_utc
from gridcast.operators.columns import ensure_columns, without
from gridcast.operators.merge import append_unseen
from gridcast.operators.ordered import running_sums
from gridcast.operators.ranges import closed_days
from gridcast.plans.features import features_for
from gridcast.schemas import GENERATION_DOCUMENT, HOLDOUT_METRICS, struct
from gridcast.session import scratch_path
from gridcast.sources import documents, manifest, metrics, tables
from queries.composites import aligned_sql, features_sql
from queries.inputs import EVENTS, SPEC, events, feature_inputs, table
from queries.registry import query, r6

EVENT_COLUMNS = struct(
    {
        "event_id": T.LongType(),
        "ts": T.TimestampNTZType(),
        "user_id": T.LongType(),
        "event_type": T.StringType(),
        "value": T.DoubleType(),
        "props": T.StringType(),
    }
)


@query(
    "scan_project",
    f"SELECT event_id, ts AS datetime, {r6('value')} AS value, CAST(NULL AS DOUBLE) AS wind_mw FROM events",
)
def scan_project(spark, sf_dir):
    chosen = ["event_id", "ts", "event_type", "value"]
    df = tables.read_table(spark, f"{sf_dir}/events.parquet", EVENT_COLUMNS, chosen)
    df = df.withColumnsRenamed({"ts": "datetime"})
    return ensure_columns(without(df, "event_type", "absent"), {"value": "double", "wind_mw": "double"})


@query("source_fallback", f"SELECT event_id, ts AS datetime, {r6('value')} AS value FROM events")
def source_fallback(spark, sf_dir):
    source = events(spark, sf_dir).select("event_id", "datetime", "value")
    missing = tables.read_table(spark, f"{sf_dir}/no_such_table.parquet", source.schema)
    empty = source.where("event_id < 0")
    return tables.first_filled(missing, empty, source)


@query(
    "write_read_roundtrip",
    f"SELECT event_id, ts AS datetime, event_type, {r6('value')} AS value FROM events",
)
def write_read_roundtrip(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "datetime", "event_type", "value")
    root = scratch_path(spark, "roundtrip")
    tables.write_series(df, f"{root}/table", order=["event_type", "event_id"])
    stored = spark.read.parquet(f"{root}/table")
    tables.snapshot_once(stored, f"{root}/snapshot")
    tables.snapshot_once(stored.where("event_id < 0"), f"{root}/snapshot")
    tables.restore(spark, f"{root}/snapshot", f"{root}/restored")
    return spark.read.parquet(f"{root}/restored").drop(*tables.PARTITIONS)


@query(
    "read_months",
    f"""WITH {EVENTS} SELECT event_id, datetime, {r6('value')} AS value FROM events_
        WHERE datetime >= TIMESTAMP '2024-01-05' AND datetime < TIMESTAMP '2024-02-01'""",
)
def read_months(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "datetime", "value")
    path = scratch_path(spark, "months")
    tables.write_series(df, path, order=["event_id"])
    return tables.read_range(spark, path, date(2024, 1, 5), date(2024, 2, 1))


METRICS_ROW = T.StructType([T.StructField("event_type", T.StringType()), *HOLDOUT_METRICS])


@query(
    "metrics_json",
    f"""SELECT event_type, {r6('sqrt(avg((value - 50) * (value - 50)))')} AS holdout_rmse_perc,
        CAST(NULL AS DOUBLE) AS optuna_best_cv_rmse, CAST(NULL AS DOUBLE) AS holdout_mape_perc, CAST(count(*) AS VARCHAR) AS iterations
        FROM events GROUP BY 1""",
)
def metrics_json(spark, sf_dir):
    rows = (
        events(spark, sf_dir)
        .groupBy("event_type")
        .agg(
            rmse(F.lit(50.0), F.col("value")).alias("holdout_rmse_perc"),
            F.create_map(F.lit("iterations"), F.count(F.lit(1)).cast("string")).alias("best_params"),
        )
    )
    path = scratch_path(spark, "metrics")
    metrics.write_document(rows, path)
    back = metrics.read_document(spark, path, METRICS_ROW, multi_line=False)
    return back.withColumn("iterations", F.try_element_at("best_params", F.lit("iterations"))).drop("best_params")


def mixes(spark, sf_dir):
    """One generation mix per line item: two fuels and a total, or an empty or absent mix."""
    def fuel(name, perc, actual):
        return F.struct(name.alias("fuel"), perc.alias("perc"), actual.alias("actual"))

    none = F.lit(None).cast("double")
    mix = F.array(
        fuel(F.col("l_returnflag"), F.col("l_tax") * 100, none),
        fuel(F.col("l_linestatus"), F.col("l_discount") * 100, F.expr("CASE WHEN l_quantity > 25 THEN l_quantity END")),
        fuel(F.lit("total"), none, F.expr("CASE WHEN l_quantity < 40 THEN l_extendedprice END")),
    )
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_linenumber") == 7, F.slice(mix, 1, 0))
        .when(F.col("l_linenumber") != 6, mix)
        .alias("generationmix"),
    )


@query(
    "mix_share",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
        CASE WHEN l_linenumber < 6 AND l_returnflag = 'A' THEN {r6('l_tax * 100')} END AS wind_perc
        FROM lineitem""",
)
def mix_share(spark, sf_dir):
    share = documents.fuel_share(F.col("generationmix"), "A")
    return mixes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", share.alias("wind_perc"))


@query(
    "mix_megawatt",
    f"""WITH found AS (
          SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 6 AND l_linestatus = 'F' THEN
            coalesce(CASE WHEN l_quantity > 25 THEN l_quantity END,
                     CASE WHEN l_quantity < 40 THEN l_extendedprice END * (l_discount * 100) / 100) END AS mw
          FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, {r6('mw')} AS wind_mw FROM found WHERE mw IS NOT NULL""",
)
def mix_megawatt(spark, sf_dir):
    output = documents.fuel_megawatts(F.col("generationmix"), "F")
    found = mixes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", output.alias("wind_mw"))
    return found.where("wind_mw IS NOT NULL")


@query(
    "columnar_to_rows",
    f"""WITH {EVENTS}
        SELECT event_id, datetime, {r6('value')} AS temperature_2m, {r6('value * 2')} AS wind_speed_10m FROM events_
        UNION ALL SELECT event_id, datetime + INTERVAL 1 HOUR, NULL, {r6('value * 3')} FROM events_
        UNION ALL SELECT event_id, datetime + INTERVAL 2 HOUR, CAST(user_id AS DOUBLE), NULL FROM events_""",
)
def columnar_to_rows(spark, sf_dir):
    hour = F.expr("INTERVAL 1 HOUR")
    ts, value = F.col("datetime"), F.col("value")
    document = F.struct(
        F.array(ts, ts + hour, ts + hour + hour).alias("time"),
        F.array(value, F.lit(None).cast("double"), F.col("user_id").cast("double")).alias("temperature_2m"),
        F.array(value * 2, value * 3).alias("wind_speed_10m"),
    )
    rows = documents.columns_to_rows(
        events(spark, sf_dir).withColumn("hourly", document),
        "hourly",
        ["time", "temperature_2m", "wind_speed_10m"],
        ["event_id"],
    )
    return rows.withColumnRenamed("time", "datetime")


@query(
    "parse_timestamps",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL
         WHEN 'purchase' THEN date_trunc('minute', ts) - INTERVAL 1 HOUR
         WHEN 'signup' THEN date_trunc('second', ts)
         ELSE date_trunc('minute', ts) END AS datetime
       FROM events""",
)
def parse_timestamps(spark, sf_dir):
    ts, kind = F.col("datetime"), F.col("event_type")
    minutes = F.date_format(ts, "yyyy-MM-dd'T'HH:mm")
    text = (
        F.when(kind == "error", F.concat(F.lit("not a time: "), minutes))
        .when(kind == "purchase", F.concat(minutes, F.lit("+01:00")))
        .when(kind == "signup", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "view", F.concat(minutes, F.lit("Z")))
        .otherwise(minutes)
    )
    return events(spark, sf_dir).select("event_id", parse_utc(text).alias("datetime"))


ORDER_RANGES = (
    "ranges AS (SELECT o_orderpriority, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last "
    "FROM orders GROUP BY 1)"
)


def order_ranges(spark, sf_dir):
    day = F.to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(F.min(day).alias("start"), F.max(day).alias("end"))


@query(
    "date_tiles",
    f"""WITH {ORDER_RANGES},
        days AS (SELECT o_orderpriority, last, unnest(generate_series(first, last, INTERVAL 30 DAY))::DATE AS first_day FROM ranges),
        months AS (SELECT o_orderpriority, unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH))::DATE AS first_day FROM ranges),
        years AS (SELECT o_orderpriority, first, last, unnest(generate_series(year(first), year(last))) AS y FROM ranges)
        SELECT o_orderpriority, 'days' AS kind, first_day, least((first_day + INTERVAL 29 DAY)::DATE, last) AS last_day FROM days
        UNION ALL SELECT o_orderpriority, 'month', first_day, last_day(first_day) FROM months
        UNION ALL SELECT o_orderpriority, 'year', greatest(make_date(y, 1, 1), first), least(make_date(y, 12, 31), last) FROM years""",
)
def date_tiles(spark, sf_dir):
    ranges = order_ranges(spark, sf_dir)
    parts = {
        "days": manifest.day_tiles(ranges, 30),
        "month": manifest.month_tiles(ranges),
        "year": manifest.year_tiles(ranges),
    }
    labelled = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


@query(
    "missing_months",
    f"""WITH {ORDER_RANGES},
        months AS (SELECT o_orderpriority, unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH))::DATE AS first_day FROM ranges),
        stored AS (SELECT DISTINCT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS first_day FROM orders WHERE o_totalprice > 490000)
        SELECT o_orderpriority, first_day, last_day(first_day) AS last_day FROM months
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.o_orderpriority = months.o_orderpriority AND s.first_day = months.first_day)""",
)
def missing_months(spark, sf_dir):
    stored = (
        table(spark, sf_dir, "orders")
        .where("o_totalprice > 490000")
        .select("o_orderpriority", F.trunc("o_orderdate", "MONTH").alias("month"))
        .distinct()
    )
    return manifest.missing_months(order_ranges(spark, sf_dir), stored, keys=["o_orderpriority"])


@query(
    "append_unseen",
    f"""SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice,
        CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'seen' ELSE 'new' END AS origin FROM orders""",
)
def append_unseen_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    seen = orders.where("o_orderdate < '1998-01-01'").withColumn("origin", F.lit("seen"))
    batch = orders.where("o_orderdate >= '1997-01-01'").withColumn("origin", F.lit("new"))
    return append_unseen(seen, batch, ["o_orderkey"]).drop("o_orderdate")


@query(
    "quarantine_split",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'missing data' END AS reason,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN date_trunc('minute', ts) END AS datetime,
        CASE WHEN event_type NOT IN ('error', 'signup', 'view') THEN {r6('value')} END AS wind_perc
        FROM events""",
)
def quarantine_split(spark, sf_dir):
    kind = F.col("event_type")
    fuel = F.when(kind == "view", "hydro").otherwise("wind")
    text = F.format_string(
        '{"data": [{"from": "%s", "generationmix": [{"fuel": "%s", "perc": %s}]}, {"from": null}]}',
        F.date_format("datetime", "yyyy-MM-dd'T'HH:mm'Z'"),
        fuel,
        F.col("value").cast("string"),
    )
    text = F.when(kind == "error", F.substring(text, 1, 30)).when(kind == "signup", '{"error": 1}').otherwise(text)
    landed = events(spark, sf_dir).select("event_id", text.alias("text"))
    checked = documents.check_documents(landed, "text", GENERATION_DOCUMENT, "data")
    good = documents.share_series(checked.good, ["event_id"])
    return good.unionByName(checked.quarantine.select("event_id", "reason"), allowMissingColumns=True)


@query(
    "export_range",
    f"""SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice, o_orderdate FROM orders
        WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1998-11-16'""",
)
def export_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    path = scratch_path(spark, "export")
    tables.export_csv(closed_days(orders, "o_orderdate", date(1996, 3, 1), date(1998, 11, 15)), path)
    return tables.read_csv(spark, path, orders.schema)


LOGS = """learn AS (SELECT user_id AS iter, sqrt(avg(value * value)) AS rmse FROM events GROUP BY 1),
    test AS (SELECT user_id + 1 AS iter, sqrt(avg((value - 1.0) * (value - 1.0))) AS rmse FROM events GROUP BY 1),
    log AS (SELECT CAST(coalesce(l.iter, t.iter) AS INTEGER) AS iter, l.rmse AS learn_rmse, t.rmse AS test_rmse
            FROM learn l FULL JOIN test t ON l.iter = t.iter)"""


def curves(spark, sf_dir):
    """Two learning curves with one point per user, written and read back as training logs."""
    root = scratch_path(spark, "curves")
    for part, shift in (("learn", 0), ("test", 1)):
        curve = events(spark, sf_dir).groupBy((F.col("user_id") + shift).alias("iter"))
        points = curve.agg(rmse(F.lit(float(shift)), F.col("value")).alias("RMSE"))
        points.write.option("header", True).option("sep", "\t").csv(f"{root}/{part}")
    return metrics.training_log(spark, f"{root}/learn", f"{root}/test")


@query(
    "training_log",
    f"WITH {LOGS} SELECT iter, {r6('learn_rmse')} AS learn_rmse, {r6('test_rmse')} AS test_rmse FROM log",
)
def training_log(spark, sf_dir):
    return curves(spark, sf_dir)


@query(
    "best_iteration",
    f"""WITH {LOGS} SELECT iter AS best_iter, {r6('test_rmse')} AS best_rmse FROM log
        WHERE test_rmse IS NOT NULL ORDER BY test_rmse, iter LIMIT 1""",
)
def best_iteration(spark, sf_dir):
    return metrics.best_iteration(curves(spark, sf_dir))


TIMES = """clock AS (SELECT user_id AS iter, CAST(1000 * count(*) AS BIGINT) AS took FROM events GROUP BY 1),
    log AS (SELECT CAST(iter AS INTEGER) AS iter, CAST(sum(took) OVER (ORDER BY iter) AS BIGINT) AS passed,
      CAST(coalesce(sum(took) OVER (ORDER BY iter ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS remaining FROM clock)"""


def time_log(spark, sf_dir):
    """A clock over the events per user, in milliseconds, written and read back as a remaining-time log."""
    path = scratch_path(spark, "times")
    took = events(spark, sf_dir).groupBy(F.col("user_id").alias("iter")).agg((1000 * F.count(F.lit(1))).alias("took"))
    summed = running_sums(took, ["iter"], "took", "Passed", "Remaining", unique=True)  # one row per user
    log = summed.select("iter", "Passed", F.coalesce("Remaining", F.lit(0)).alias("Remaining"))
    log.write.option("header", True).option("sep", "\t").csv(path)
    return metrics.training_time(spark, path)


@query("training_time", f"WITH {TIMES} SELECT iter, passed, remaining FROM log")
def training_time(spark, sf_dir):
    return time_log(spark, sf_dir)


@query(
    "time_report",
    f"""WITH {TIMES} SELECT CAST(max(iter) - min(iter) + 1 AS BIGINT) AS iterations, arg_max(passed, iter) AS passed,
          {r6('arg_max(passed, iter) / (max(iter) - min(iter) + 1)')} AS per_iteration,
          arg_min(passed + remaining, iter) - arg_max(passed, iter) AS estimate_off FROM log""",
)
def time_report(spark, sf_dir):
    return metrics.time_report(time_log(spark, sf_dir))


MODE_COLUMNS = ["event_type", "datetime", "wind_perc", "wind_perc_lag_48h", "wind_speed_roll_std_48h"]


@query(
    "mode_switch",
    f"""WITH {aligned_sql('full_', '')}, {features_sql('full_')},
             {aligned_sql('cut_', "WHERE ts < TIMESTAMP '2024-01-15'")}, {features_sql('cut_')}
        SELECT 'training' AS mode, event_type, datetime, {r6('wind_perc')} AS wind_perc,
               {r6('wind_perc_lag_48h')} AS wind_perc_lag_48h, {r6('wind_speed_roll_std_48h')} AS wind_speed_roll_std_48h
        FROM cut_features
        UNION ALL SELECT 'inference', event_type, datetime, {r6('wind_perc')},
               {r6('wind_perc_lag_48h')}, {r6('wind_speed_roll_std_48h')} FROM full_features""",
)
def mode_switch(spark, sf_dir):
    generation, weather, holidays = feature_inputs(spark, sf_dir)
    cut = "datetime < timestamp'2024-01-15'"
    inputs = {"training": (generation.where(cut), weather.where(cut)), "inference": (generation, weather)}
    options = {"spec": SPEC, "generation_order": ["event_id"]}
    parts = [
        features_for(mode, inputs, holidays, **options).select(F.lit(mode).alias("mode"), *MODE_COLUMNS)
        for mode in inputs
    ]
    return parts[0].unionByName(parts[1])
