"""Queries of the general training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsql.operators import instants, nested, references, rolling, versions
from fedsql.plans import training_sql
from fedsql.session import shared_path, table, written

HOME = "Asia/Shanghai"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_key, field_name, text, zone, ord) of the four raw fields."""
    demo, site, member = (table(spark, d, t) for t in ("demo", "site_orders", "member_orders"))
    one = lambda df, t, key, field, zone, order: df.select(
        F.lit(t).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.lit(field).alias("field_name"), F.col(field).alias("text"), zone.alias("zone"), order.alias("ord"))
    home, none = F.lit(HOME), F.lit(0).cast("bigint")
    return reduce(DataFrame.unionByName, (
        one(demo, "demo", "_id", "start_date", home, none), one(demo, "demo", "_id", "created_at", home, none),
        one(site, "site_orders", "order_id", "order_at", F.coalesce("time_zone", F.lit("UTC")), F.col("order_id")),
        one(member, "member_orders", "id", "create_time", home, F.col("id")),
    )).filter("row_key is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    raw = t.select(F.concat_ws(".", "table_name", "field_name").alias("source"), F.col("row_key").alias("key"), "ord", "text", "zone", instants.strict(F.col("text")).alias("strict"))
    every = instants.readings(F.col("text"), F.col("zone"), against=instants.AGAINST)  # TESTDATA.md's rules are costs
    return (
        instants.resolve(raw, states=every, keep=("strict",)).filter("us is not null and not strict")
        .select(F.split("source", r"\.")[0].alias("table_name"), F.col("key").alias("row_key"), F.split("source", r"\.")[1].alias("field_name"), F.col("us").alias("utc_us"))
    )


def _member_days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "member_orders").filter("id is not null").select(
        F.lit("member_orders.create_time").alias("source"), F.col("id").alias("key"), F.col("create_time").alias("text"), F.lit(HOME).alias("zone"), "member_id", "pay_amount")
    read = instants.resolve(o, "key", instants.readings(F.col("text"), F.col("zone")), keep=("member_id", "pay_amount"))
    at = F.timestamp_micros("us")
    return read.select(F.col("member_id").alias("entity"), F.to_date(F.from_utc_timestamp(at, HOME)).alias("day"), rolling.cents(F.col("pay_amount")).alias("cents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    daily = written(rolling.daily_totals(_member_days(spark, d)), "daily")  # both sides of the range join read it
    days = rolling.trailing(daily)
    return days.filter("not active and sum_7 * 30 > sum_30 * 7").select(F.col("entity").alias("member_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


GOODS = ("order", "goodses", "[]", "goodsId")
PAY_TYPES = ("order", "payInfo", "payTypes", "[]")
TIMEOUTS = ("rules", "[]", "timeout_time")
SITES = ("sites", "[]")
FIELDS = {GOODS: "goodsId", PAY_TYPES: "payTypes", TIMEOUTS: "timeout_time", SITES: "sites"}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    user, demo, raw = (table(spark, d, t) for t in ("user_data", "demo", "raw_records"))
    raw = raw.filter("record_no is not null").select("record_no", "payload").distinct()
    arrays = [p[: p.index("[]")] for p in FIELDS]
    tables_ = (
        ("user_data", nested.shred(user.filter("order.orderId is not null"), F.col("order.orderId"), (GOODS, PAY_TYPES))),
        ("demo", nested.shred(demo.filter("_id is not null"), F.col("_id"), (TIMEOUTS, SITES))),
        ("raw_records", nested.shred_json(raw, F.col("record_no"), F.col("payload"), arrays, list(FIELDS))),
    )
    names = F.create_map(*(F.lit(x) for p, n in FIELDS.items() for x in ("/".join(p), n)))
    nodes = reduce(DataFrame.unionByName, (n.withColumn("table_name", F.lit(t)) for t, n in tables_))
    return nested.elements(nodes).select("table_name", "parent_key", names[F.col("path")].alias("field_name"), F.col("pos").cast("bigint").alias("pos"), F.col("value").alias("child"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "run_log").filter("run_no is not null and started_at is not null").select("run_no", F.unix_micros("started_at").alias("us"), "state").distinct().collect()  # a fixed table of runs
    feed = table(spark, d, "order_feed").withColumn("arrived_us", F.unix_micros("arrived_at"))
    taken = versions.replay(feed, [(r.run_no, r.us, r.state == "done") for r in log], "arrived_us", "id", "modify_time", shared_path(spark, "runs"))
    return taken.read().select("run_no", "id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    code = lambda c: F.lower(F.regexp_replace(c, r"^[\s　 ]+|[\s　 ]+$", ""))
    refs = lambda df, t, row, key, ts: df.select(F.lit(t).alias("table_name"), F.col(row).alias("row_id"), key.cast("string").alias("key"), F.col(ts).alias("ts"))
    lives = lambda df, t, key: references.deltas_of_lives(df, t, key.cast("string"), F.col("created_at"), F.col("deleted_at"))
    asked = refs(table(spark, d, "site_orders").filter("site_id <> 0"), "site_orders", "order_id", F.col("site_id"), "arrived_at").unionByName(
        refs(table(spark, d, "services"), "services", "service_id", code("device_code"), "updated_at").filter("key <> ''")
    )
    existence = lives(table(spark, d, "sites"), "site_orders", F.col("site_id")).unionByName(lives(table(spark, d, "devices"), "services", code("code")))
    found = references.orphans_at(asked, existence)
    return found.select("table_name", "row_id", F.date_format("ts", "yyyy-MM").alias("period"), "reason")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found}

SQL = {
    **training_sql.SQL,
    "p5_found": """
        WITH done AS (SELECT run_no, started_at, lag(started_at) OVER (ORDER BY started_at) AS since FROM run_log WHERE state = 'done'),
        latest AS (
          SELECT d.run_no, d.started_at, f.id, max(coalesce(epoch_us(f.modify_time), -9223372036854775808)) AS m
          FROM order_feed f JOIN done d ON f.arrived_at < d.started_at AND (d.since IS NULL OR f.arrived_at >= d.since)
          GROUP BY 1, 2, 3),
        seen AS (SELECT *, max(m) OVER (PARTITION BY id ORDER BY started_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM latest)
        SELECT run_no, id FROM seen WHERE before IS NULL OR m > before""",
    "p6_found": """
        WITH refs AS (
          SELECT DISTINCT 'site_orders' AS table_name, order_id AS row_id, CAST(site_id AS VARCHAR) AS key, arrived_at AS ts FROM site_orders WHERE site_id <> 0
          UNION ALL
          SELECT DISTINCT 'services', service_id, lower(trim(device_code, E' \\t\\r\\n\\u3000\\u00a0')), updated_at FROM services WHERE trim(device_code, E' \\t\\r\\n\\u3000\\u00a0') <> ''),
        lives AS (
          SELECT 'site_orders' AS table_name, CAST(site_id AS VARCHAR) AS key, created_at, deleted_at FROM sites
          UNION ALL SELECT 'services', lower(trim(code, E' \\t\\r\\n\\u3000\\u00a0')), created_at, deleted_at FROM devices)
        SELECT r.table_name, r.row_id, strftime(r.ts, '%Y-%m') AS period,
               CASE WHEN count(l.key) = 0 THEN 'missing' WHEN min(l.created_at) > r.ts THEN 'late' ELSE 'deleted' END AS reason
        FROM refs r LEFT JOIN lives l ON r.table_name = l.table_name AND r.key = l.key
        WHERE r.ts IS NOT NULL
        GROUP BY r.table_name, r.row_id, r.ts
        HAVING coalesce(bool_or(l.created_at <= r.ts AND (l.deleted_at IS NULL OR r.ts < l.deleted_at)), false) = false""",
}
