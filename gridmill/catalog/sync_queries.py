"""Table synchronisation."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from gridmill.catalog.registry import query, table
from gridmill.operators.tablesync import (
    append_if_newer,
    append_newer,
    full_refresh,
    new_since,
    read_current,
)
from gridmill.session import work_path

COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("full_refresh", "SELECT * FROM orders")
def _refresh(spark, sf):
    root = work_path(spark, "orders")
    full_refresh(table(spark, sf, "orders"), root, datetime(2024, 1, 31))
    return read_current(spark, root)


@query(
    "watermark_append",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
    WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')""",
)
def _append(spark, sf):
    orders = table(spark, sf, "orders").select(*COLS)
    return append_newer(orders, orders.where(F.col("o_orderdate") < ntz("1998-01-01")), "o_orderdate")


@query(
    "load_time_watermark",
    """
    WITH e AS (SELECT event_id, ts, ts + CASE WHEN event_type = 'error' THEN INTERVAL 2 HOURS ELSE INTERVAL 5 MINUTES END AS load_ts
               FROM events)
    SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'
      AND load_ts > (SELECT max(load_ts) FROM e WHERE ts < TIMESTAMP '2024-01-10 12:00:00')""",
)
def _since(spark, sf):
    late = F.when(F.col("event_type") == "error", F.expr("INTERVAL 2 HOURS")).otherwise(
        F.expr("INTERVAL '0 02:05:00' DAY TO SECOND") - F.expr("INTERVAL 2 HOURS")
    )
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("ts") + late).alias("load_ts"))
    loaded = e.where(F.col("ts") < ntz("2024-01-10 12:00:00"))
    return new_since(e, loaded, "load_ts", "ts", date(2024, 1, 10))


@query(
    "guarded_append",
    """
    WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
               WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus = 'F')
    SELECT * FROM d UNION ALL
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
    WHERE o_orderdate > (SELECT max(o_orderdate) FROM d)""",
)
def _guarded(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.where((F.col("o_orderdate") < ntz("1998-01-01")) & (F.col("o_orderstatus") == "F"))
    return append_if_newer(orders.select(*COLS), old.select(*COLS), "o_orderdate")
