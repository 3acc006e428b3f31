"""Change capture, inventory and run history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.catalog.registry import query, table, with_
from gridmill.operators.changes import (
    BatchRange,
    acknowledge,
    apply_deletes,
    batch_bounds,
    batch_range,
    latest_deletes,
    latest_upserts,
    merge_changes,
    next_log,
    reconcile,
    snapshot_diff,
)
from gridmill.operators.inventory import mark_absent, mark_superseded, scd_upsert
from gridmill.operators.latest import latest_changes
from gridmill.operators.runs import run_history
from gridmill.plans.inventory import inventory_run, read_inventory
from gridmill.plans.replication import create_buckets, merge_buckets, read_buckets
from gridmill.session import work_path
from gridmill.streaming.merge import merge_stream

KEY = ["user_id"]
SEQ = "event_id"
TARGET = "target.users"
BUCKETS = 16


def track(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of their user."""
    return as_track(table(spark, sf, "events"))


def as_track(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id",
        "event_id",
        "value",
        F.when(F.col("event_type") == "error", "D")
        .when(F.col("event_type") == "signup", "I")
        .otherwise("U")
        .alias("status"),
    )


def log(spark: SparkSession, sf: str) -> DataFrame:
    """A log that has replicated the first half of the sequence."""
    half = F.call_function("div", F.max(SEQ), F.lit(2))
    return table(spark, sf, "events").agg(half.alias("last_row_replicated")).withColumn(
        "target_tablename", F.lit(TARGET)
    )


def bounds(spark: SparkSession, sf: str) -> BatchRange:
    return batch_range(track(spark, sf), SEQ, log(spark, sf), TARGET)


def target(spark: SparkSession, sf: str, b: BatchRange) -> DataFrame:
    """Users as the first half of the changes left them."""
    return latest_upserts(latest_changes(track(spark, sf), KEY, SEQ, high=b.last_replicated)).drop("status")


def batch(spark: SparkSession, sf: str, b: BatchRange) -> DataFrame:
    return latest_changes(track(spark, sf), KEY, SEQ, b.last_replicated, b.high)


TRACK = """
track AS (
  SELECT user_id, event_id, value,
         CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS status
  FROM events),
half AS (SELECT max(event_id) // 2 AS h, max(event_id) AS m FROM events),
target AS (
  SELECT user_id, event_id, value FROM (
    SELECT t.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
    FROM track t, half WHERE event_id <= h) WHERE rn = 1 AND status <> 'D'),
latest AS (
  SELECT user_id, event_id, value, status FROM (
    SELECT t.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
    FROM track t, half WHERE event_id > h AND event_id <= m) WHERE rn = 1)"""


@query("latest_per_key", with_(TRACK) + " SELECT * FROM latest")
def _latest(spark, sf):
    return batch(spark, sf, bounds(spark, sf))


@query(
    "ack_sequence",
    with_(TRACK)
    + """
    SELECT user_id, event_id,
      CASE WHEN event_id <= h THEN event_id + 1
           ELSE h + 1 + row_number() OVER (PARTITION BY event_id > h ORDER BY event_id) END AS ack,
      CASE WHEN event_id > h THEN TIMESTAMP '2024-01-31' END AS ack_time
    FROM track, half""",
)
def _ack(spark, sf):
    """The first half is acknowledged, the rest is not."""
    h = bounds(spark, sf).last_replicated
    rows = track(spark, sf).select(
        "user_id",
        "event_id",
        F.when(F.col(SEQ) <= h, F.col(SEQ) + 1).alias("ack"),
        F.lit(None).cast("timestamp_ntz").alias("ack_time"),
    )
    return acknowledge(rows, KEY, SEQ, "ack", "ack_time", h + 1, datetime(2024, 1, 31))


@query(
    "cdc_batch_range",
    "SELECT max(event_id) // 2 + 1 AS low, max(event_id) AS high, max(event_id) > max(event_id) // 2 AS has_new FROM events",
)
def _range(spark, sf):
    return batch_bounds(track(spark, sf), SEQ, log(spark, sf), TARGET)


@query("cdc_latest_deletes", with_(TRACK) + " SELECT user_id FROM latest WHERE status = 'D'")
def _deletes(spark, sf):
    return latest_deletes(batch(spark, sf, bounds(spark, sf)), KEY)


@query("cdc_latest_upserts", with_(TRACK) + " SELECT * FROM latest WHERE status <> 'D'")
def _upserts(spark, sf):
    return latest_upserts(batch(spark, sf, bounds(spark, sf)))


@query(
    "cdc_apply_deletes",
    with_(TRACK)
    + " SELECT * FROM target WHERE user_id NOT IN (SELECT user_id FROM latest WHERE status = 'D')",
)
def _apply(spark, sf):
    b = bounds(spark, sf)
    return apply_deletes(target(spark, sf, b), latest_deletes(batch(spark, sf, b), KEY), KEY)


@query(
    "cdc_merge",
    with_(TRACK)
    + """
    SELECT * FROM target WHERE user_id NOT IN (SELECT user_id FROM latest)
    UNION ALL SELECT user_id, event_id, value FROM latest WHERE status <> 'D'""",
)
def _merge(spark, sf):
    b = bounds(spark, sf)
    return merge_changes(
        target(spark, sf, b), track(spark, sf), KEY, SEQ, b.last_replicated, b.high
    )


MERGED = """
    SELECT * FROM target WHERE user_id NOT IN (SELECT user_id FROM latest)
    UNION ALL SELECT user_id, event_id, value FROM latest WHERE status <> 'D'"""


@query("cdc_merge_buckets", with_(TRACK) + MERGED)
def _merge_buckets(spark, sf):
    """The same merge into a table of buckets, of which only those of changed keys are rewritten."""
    b, path = bounds(spark, sf), work_path(spark, "users")
    create_buckets(target(spark, sf, b), path, KEY, BUCKETS)
    merge_buckets(track(spark, sf), path, KEY, SEQ, BUCKETS, b.last_replicated, b.high)
    return read_buckets(spark, path)


@query("cdc_merge_stream", with_(TRACK) + MERGED)
def _merge_stream(spark, sf):
    """The same merge as a stream over the track table's file."""
    b = bounds(spark, sf)
    path, checkpoint = work_path(spark, "users"), work_path(spark, "progress")
    create_buckets(target(spark, sf, b), path, KEY, BUCKETS)
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    changes = as_track(events).where(F.col(SEQ) > b.last_replicated)
    run = merge_stream(changes, path, KEY, SEQ, checkpoint, buckets=BUCKETS)
    run.awaitTermination()
    return read_buckets(spark, path)


@query(
    "merge_reconcile",
    with_(TRACK)
    + """
    SELECT count(*) AS batch_rows, count(*) FILTER (t.user_id IS NULL) AS inserts,
           count(*) FILTER (t.user_id IS NOT NULL) AS updates, true AS rows_match,
           CAST((SELECT m - h FROM half) AS INTEGER) AS batch_range
    FROM (SELECT user_id FROM latest WHERE status <> 'D') l LEFT JOIN target t ON l.user_id = t.user_id""",
)
def _reconcile(spark, sf):
    b = bounds(spark, sf)
    return reconcile(target(spark, sf, b), latest_upserts(batch(spark, sf, b)), KEY, b.length)


@query(
    "ack_null_sequence",
    """
    WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 10 <> 0 THEN event_id END AS seq FROM events)
    SELECT user_id, event_id, 7 + row_number() OVER (ORDER BY seq NULLS LAST, user_id, event_id) AS ack,
           TIMESTAMP '2024-01-31' AS ack_time
    FROM t""",
)
def _ack_null(spark, sf):
    """Every tenth row has no sequence."""
    rows = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("seq"),
        F.lit(None).cast("long").alias("ack"),
        F.lit(None).cast("timestamp_ntz").alias("ack_time"),
    )
    return acknowledge(rows, ["user_id", "event_id"], "seq", "ack", "ack_time", 7, datetime(2024, 1, 31)).drop("seq")


@query(
    "replication_log",
    """
    WITH half AS (SELECT max(event_id) // 2 AS h, max(event_id) AS m FROM events)
    SELECT 'events' AS source_tablename, 'target.users' AS target_tablename, n AS last_row_replicated,
      logged AS last_row_replicated_timestamp, CAST(0 AS BIGINT) AS batch_elapsed_seconds
    FROM half, LATERAL (VALUES (h, TIMESTAMP '2024-01-30'), (m, TIMESTAMP '2024-01-31')) AS v(n, logged)""",
)
def _log(spark, sf):
    """The log after one more batch."""
    before = log(spark, sf).select(
        F.lit("events").alias("source_tablename"),
        "target_tablename",
        "last_row_replicated",
        F.lit(datetime(2024, 1, 30)).cast("timestamp_ntz").alias("last_row_replicated_timestamp"),
        F.lit(0).cast("long").alias("batch_elapsed_seconds"),
    )
    return next_log(before, track(spark, sf), SEQ, "events", TARGET, datetime(2024, 1, 31))


@query(
    "change_track_rows",
    """
    WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    n AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal
          FROM customer WHERE c_acctbal >= 0)
    SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name,
      CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal,
      CASE WHEN o.c_custkey IS NULL THEN 'I' WHEN n.c_custkey IS NULL THEN 'D' ELSE 'U' END AS status,
      'loader' AS userid
    FROM o FULL JOIN n ON o.c_custkey = n.c_custkey
    WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal OR o.c_name <> n.c_name""",
)
def _diff(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where(F.col("c_mktsegment") != "MACHINERY").select("c_custkey", "c_name", "c_acctbal")
    balance = F.when(F.col("c_nationkey") < 5, F.col("c_acctbal") * 2).otherwise(F.col("c_acctbal"))
    new = c.where(F.col("c_acctbal") >= 0).select("c_custkey", "c_name", balance.alias("c_acctbal"))
    return snapshot_diff(old, new, ["c_custkey"], "loader")


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as instances of an account per segment and nation."""
    return table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("account_name"),
        F.col("c_nationkey").cast("string").alias("account_number"),
        F.col("c_name").alias("instance_name"),
        F.lit("2024-01-01").alias("create_date"),
        F.col("c_acctbal").alias("ppm"),
    )


@query(
    "inventory_upsert",
    """
    WITH i AS (SELECT c_mktsegment AS account_name, CAST(c_nationkey AS VARCHAR) AS account_number,
                      c_name AS instance_name, '2024-01-01' AS create_date, c_acctbal AS ppm, c_nationkey FROM customer),
    cur AS (SELECT *, CASE WHEN ppm < 0 THEN 'deleted' ELSE 'current' END AS dba_state FROM i WHERE account_name <> 'BUILDING'),
    snap AS (SELECT * REPLACE (CASE WHEN c_nationkey < 5 THEN ppm + 1 ELSE ppm END AS ppm) FROM i WHERE account_name <> 'FURNITURE')
    SELECT c.dba_state, c.account_name, c.account_number, c.instance_name, c.create_date,
           coalesce(s.ppm, c.ppm) AS ppm, CASE WHEN s.ppm <> c.ppm THEN 'update' END AS change
    FROM cur c LEFT JOIN snap s ON s.instance_name = c.instance_name
    UNION ALL
    SELECT 'current', account_name, account_number, instance_name, create_date, ppm, 'insert'
    FROM snap WHERE account_name = 'BUILDING' AND c_nationkey < 15""",
)
def _upsert_inventory(spark, sf):
    rows = instances(spark, sf)
    current = rows.where(F.col("account_name") != "BUILDING").withColumn(
        "dba_state", F.when(F.col("ppm") < 0, "deleted").otherwise("current")
    )
    low = F.col("account_number").cast("int") < 5
    snapshot = rows.where(F.col("account_name") != "FURNITURE").withColumn(
        "ppm", F.when(low, F.col("ppm") + 1).otherwise(F.col("ppm"))
    )
    accounts = (
        rows.select("account_name", "account_number")
        .distinct()
        .withColumn(
            "label",
            F.when(F.col("account_number").cast("int") < 15, "prod-safety").otherwise("prod"),
        )
    )
    return scd_upsert(current, snapshot, accounts)


@query(
    "superseded_mark",
    """
    SELECT o_orderkey, o_custkey, o_orderdate,
      CASE WHEN o_orderdate < max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END) OVER (PARTITION BY o_custkey)
           THEN 'deleted' ELSE 'current' END AS dba_state
    FROM orders""",
)
def _superseded(spark, sf):
    """Orders as instances of a customer; those of status P are the new ones."""
    orders = table(spark, sf, "orders")
    current = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", F.lit("current").alias("dba_state")
    )
    new = orders.where(F.col("o_orderstatus") == "P")
    return mark_superseded(current, new, ["o_custkey"], "o_orderdate")


@query(
    "absent_mark",
    """
    WITH c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'current' END AS dba_state
               FROM orders)
    SELECT o_orderkey, o_custkey,
      CASE WHEN o_custkey IN (SELECT o_custkey FROM c WHERE dba_state = 'current')
            AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
           THEN 'deleted' ELSE dba_state END AS dba_state
    FROM c""",
)
def _absent(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("current")
    current = table(spark, sf, "orders").select("o_orderkey", "o_custkey", state.alias("dba_state"))
    snapshot = table(spark, sf, "customer").where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("o_custkey")
    )
    return mark_absent(current, snapshot, ["o_custkey"])


@query(
    "run_history",
    """
    WITH s AS (SELECT user_id, ts AS start_datetime FROM events WHERE event_type = 'signup'),
    e AS (SELECT user_id, max(ts) AS t, arg_max(value, ts) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT s.user_id, start_datetime, CASE WHEN t >= start_datetime THEN t END AS end_datetime,
      CASE WHEN t >= start_datetime THEN 'END' ELSE 'START' END AS status,
      CASE WHEN t >= start_datetime THEN (epoch_us(t) - epoch_us(start_datetime)) / 1000000.0 END AS run_seconds,
      CASE WHEN t >= start_datetime THEN v END AS value
    FROM s LEFT JOIN e ON s.user_id = e.user_id""",
)
def _runs(spark, sf):
    state = F.when(F.col("event_type") == "signup", "START").when(
        F.col("event_type") == "purchase", "END"
    )
    events = table(spark, sf, "events").select("user_id", "ts", "value", state.alias("state"))
    return run_history(events, ["user_id"], "state", "ts", end_cols=["value"])


def write_inventory(customers: DataFrame, created: Column, price: Column, path: str) -> None:
    """Customers as inventory documents of one instance each, a line a document."""
    doc = F.struct(
        F.struct(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("owner_id")).alias("account"),
        F.col("c_name").alias("instance_id"),
        created.alias("create_date"),
        F.concat(F.lit("$"), F.format_number(price.cast("decimal(18,2)"), 2)).alias("price_per_month"),
    )
    customers.select(F.to_json(F.array(doc)).alias("value")).write.text(path)


@query(
    "inventory_run",
    """
    WITH c AS (SELECT c_mktsegment AS an, c_nationkey AS k, c_name AS i, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS b, c_acctbal < 0 AS neg FROM customer),
    cur AS (SELECT an, k, i, '2024-01-01' AS d, b AS p, CASE WHEN neg THEN 'deleted' ELSE 'current' END AS st FROM c WHERE an <> 'BUILDING'),
    snap AS (SELECT an, k, i, CASE WHEN k = 7 THEN '2024-02-01' ELSE '2024-01-01' END AS d,
                    b + CASE WHEN k < 5 THEN 1 ELSE 0 END AS p FROM c WHERE an <> 'FURNITURE'),
    up AS (
      SELECT cur.an, cur.i, cur.d, coalesce(s.p, cur.p) AS p, st, CASE WHEN s.p <> cur.p THEN 'update' END AS change
      FROM cur LEFT JOIN snap s ON s.i = cur.i AND s.d = cur.d
      UNION ALL
      SELECT an, i, d, p, 'current', 'insert' FROM snap s
      WHERE k < 15 AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.i = s.i AND cur.d = s.d)),
    m AS (SELECT *, CASE WHEN d < max(CASE WHEN change = 'insert' THEN d END) OVER (PARTITION BY i) THEN 'deleted' ELSE st END AS st2 FROM up)
    SELECT CASE WHEN an = 'FURNITURE' AND bool_or(st2 = 'current') OVER (PARTITION BY i) THEN 'deleted' ELSE st2 END AS dba_state,
           i AS instance_name, d AS create_date, CAST(p AS DOUBLE) AS ppm, change
    FROM m""",
)
def _inventory_run(spark, sf):
    """Customers as instances; those of nation 7 are created anew, dearer in nations 0 to 4."""
    c = table(spark, sf, "customer")
    old, new = work_path(spark, "inventory"), work_path(spark, "inventory")
    price = F.abs("c_acctbal")
    write_inventory(c.where("c_mktsegment <> 'BUILDING'"), F.lit("2024-01-01"), price, old)
    again = F.when(F.col("c_nationkey") == 7, "2024-02-01").otherwise("2024-01-01")
    dearer = price + F.when(F.col("c_nationkey") < 5, 1).otherwise(0)
    write_inventory(c.where("c_mktsegment <> 'FURNITURE'"), again, dearer, new)
    gone = c.select(F.col("c_name").alias("instance_name"), F.when(F.col("c_acctbal") < 0, "deleted").otherwise("current").alias("dba_state"))
    current = read_inventory(spark, old).join(gone, "instance_name")
    label = F.when(F.col("account_number").cast("int") < 15, "prod-safety").otherwise("prod")
    accounts = instances(spark, sf).select("account_name", "account_number").distinct().withColumn("label", label)
    out = inventory_run(current, read_inventory(spark, new), accounts)
    return out.select("dba_state", "instance_name", "create_date", F.col("ppm").cast("double").alias("ppm"), "change")
