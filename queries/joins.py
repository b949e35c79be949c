"""Joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import merge
from gridcast.operators.asof import nearest_join
from queries.inputs import EVENTS, HOURLY, IS_HOLIDAY, KEYS, calendar, events, hourly, table
from queries.registry import query, r6

NEAREST = f"""WITH {HOURLY}, {EVENTS},
    before_ AS (SELECT h.event_type, h.datetime, h.speed, e.datetime AS b_at, e.event_id AS b_id, e.value AS b_value
        FROM hourly h ASOF LEFT JOIN events_ e ON h.event_type = e.event_type AND h.datetime >= e.datetime),
    both_ AS (SELECT b.*, e.datetime AS a_at, e.event_id AS a_id, e.value AS a_value,
          epoch_us(b.datetime) - epoch_us(b_at) AS behind, epoch_us(e.datetime) - epoch_us(b.datetime) AS ahead
        FROM before_ b ASOF LEFT JOIN events_ e ON b.event_type = e.event_type AND b.datetime <= e.datetime),
    near_ AS (SELECT *, CASE
          WHEN behind <= 1800000000 AND (ahead IS NULL OR ahead > 1800000000 OR behind <= ahead) THEN 'b'
          WHEN ahead <= 1800000000 THEN 'a' END AS side FROM both_)
    SELECT event_type, datetime, {r6('speed')} AS speed,
      CASE side WHEN 'b' THEN b_id WHEN 'a' THEN a_id END AS event_id,
      CASE side WHEN 'b' THEN {r6('b_value')} WHEN 'a' THEN {r6('a_value')} END AS value
    FROM near_"""


def nearest(spark, sf_dir, **options):
    left = hourly(spark, sf_dir).drop("n")
    right = events(spark, sf_dir).select("event_type", "datetime", "event_id", "value")
    return nearest_join(left, right, keys=KEYS, right_order=["event_id"], unique=True, **options)


@query("asof_nearest", NEAREST)
def asof_nearest(spark, sf_dir):
    return nearest(spark, sf_dir)


@query("asof_nearest_bucket", NEAREST)
def asof_nearest_bucket(spark, sf_dir):
    return nearest(spark, sf_dir, strategy="bucket")


@query("asof_nearest_ordered", NEAREST)
def asof_nearest_ordered(spark, sf_dir):
    return nearest(spark, sf_dir, strategy="ordered", chunk_rows=1000)


@query(
    "outer_merge",
    f"""WITH {HOURLY}, p AS (SELECT event_type, datetime + INTERVAL 1 HOUR AS datetime, speed FROM hourly)
        SELECT event_type, datetime, {r6('h.speed')} AS actual, {r6('p.speed')} AS prediction
        FROM hourly h FULL JOIN p USING (event_type, datetime)""",
)
def outer_merge(spark, sf_dir):
    series = hourly(spark, sf_dir)
    actual = series.select("event_type", "datetime", F.col("speed").alias("actual"))
    later = (F.col("datetime") + F.expr("INTERVAL 1 HOUR")).alias("datetime")
    predicted = series.select("event_type", later, F.col("speed").alias("prediction"))
    return merge.outer_merge(actual, predicted, ["event_type", "datetime"])


@query(
    "prediction_override",
    f"""WITH {HOURLY} SELECT event_type, datetime,
          CASE WHEN datetime >= TIMESTAMP '2024-01-20' AND n > 1 THEN {r6('speed + 1')} ELSE {r6('speed')} END AS prediction
        FROM hourly""",
)
def prediction_override(spark, sf_dir):
    series = hourly(spark, sf_dir)
    full = series.select("event_type", "datetime", F.col("speed").alias("prediction"))
    recent = series.where("datetime >= timestamp'2024-01-20' AND n > 1")
    latest = recent.select("event_type", "datetime", (F.col("speed") + 1).alias("prediction"))
    return merge.override(full, latest, ["event_type", "datetime"])


@query(
    "holiday_flag",
    f"""SELECT o_orderkey, o_orderdate, CASE WHEN {IS_HOLIDAY.format('o_orderdate')} THEN 1 ELSE 0 END AS is_holiday
        FROM orders""",
)
def holiday_flag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    day = F.to_date("o_orderdate")
    return merge.flag_members(orders, day, calendar(spark, orders, "o_orderdate"))


@query(
    "union_by_name",
    f"""SELECT o_custkey AS custkey, o_orderkey AS orderkey, {r6('o_totalprice')} AS amount, NULL AS name FROM orders
        UNION ALL SELECT c_custkey, NULL, {r6('c_acctbal')}, c_name FROM customer""",
)
def union_by_name(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("amount")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("custkey")
    )
    return merge.union_by_name(orders, customers)
