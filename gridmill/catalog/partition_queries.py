"""Time partitions and checks."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.catalog.registry import query, table
from gridmill.functions.times import quarter_label
from gridmill.operators.checks import duplicate_keys, null_count, orphans
from gridmill.operators.partitions import (
    expired,
    expired_pairs,
    extend_partitions,
    partition_bounds,
    route,
    route_quarter,
)
from gridmill.plans.prune import prune_run
from gridmill.session import work_path

AS_OF = datetime(2001, 8, 1)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate")


@query(
    "route_week_month",
    """
    SELECT o_orderkey, 'orders' || strftime(date_trunc('week', o_orderdate), '_%Y%m%d_') || 'week' AS week_part,
           'orders' || strftime(date_trunc('month', o_orderdate), '_%Y%m%d_') || 'month' AS month_part
    FROM orders""",
)
def _route(spark, sf):
    by_week = route(orders(spark, sf), "o_orderdate", "week", "orders").withColumnRenamed(
        "partition_name", "week_part"
    )
    both = route(by_week, "o_orderdate", "month", "orders")
    return both.select("o_orderkey", "week_part", F.col("partition_name").alias("month_part"))


@query(
    "route_quarter",
    """
    SELECT o_orderkey, 'orders_' || year(o_orderdate) || '_Q' || quarter(o_orderdate) AS partition_name
    FROM orders""",
)
def _route_quarter(spark, sf):
    out = route_quarter(orders(spark, sf), "o_orderdate", "orders")
    return out.select("o_orderkey", "partition_name")


@query(
    "partition_bounds",
    """
    SELECT DISTINCT 'orders' || strftime(date_trunc('week', o_orderdate), '_%Y%m%d_') || 'week' AS partition_name,
      date_trunc('week', o_orderdate)::TIMESTAMP AS partition_start,
      date_trunc('week', o_orderdate)::TIMESTAMP + INTERVAL 7 DAYS AS partition_end
    FROM orders""",
)
def _bounds(spark, sf):
    return partition_bounds(orders(spark, sf), "o_orderdate", "week", "orders")


def catalog_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions that hold the orders of a status: F by month, O by week, P by list."""
    o = table(spark, sf, "orders")
    week = F.col("o_orderstatus") == "O"
    start = F.when(week, F.date_trunc("week", "o_orderdate")).otherwise(
        F.date_trunc("month", "o_orderdate")
    )
    step = F.when(week, F.col("s") + F.expr("INTERVAL 7 DAYS")).otherwise(
        F.col("s") + F.expr("INTERVAL 1 MONTH")
    )
    ranges = (
        o.select("o_orderstatus", start.cast("timestamp_ntz").alias("s"))
        .distinct()
        .select(
            F.lit("sales").alias("schemaname"),
            F.col("o_orderstatus").alias("tablename"),
            F.date_format("s", "yyyyMMdd").cast("int").alias("partitionrank"),
            F.col("s").alias("partitionrangestart"),
            step.cast("timestamp_ntz").alias("partitionrangeend"),
            F.when(F.col("o_orderstatus") == "P", "list").otherwise("range").alias("partitiontype"),
            F.lit(False).alias("partitionisdefault"),
        )
    )
    none = F.lit(None).cast("timestamp_ntz")
    default = o.where(week).select(
        F.lit("sales").alias("schemaname"),
        F.col("o_orderstatus").alias("tablename"),
        F.lit(None).cast("int").alias("partitionrank"),
        none.alias("partitionrangestart"),
        none.alias("partitionrangeend"),
        F.lit("range").alias("partitiontype"),
        F.lit(True).alias("partitionisdefault"),
    ).distinct()
    return ranges.unionByName(default)


@query(
    "extend_calendar",
    """
    WITH f AS (SELECT max(date_trunc('month', o_orderdate))::TIMESTAMP + INTERVAL 1 MONTH AS e FROM orders WHERE o_orderstatus = 'F'),
    o AS (SELECT max(date_trunc('week', o_orderdate))::TIMESTAMP + INTERVAL 7 DAYS AS e FROM orders WHERE o_orderstatus = 'O'),
    n AS (
      SELECT 'F' AS tablename, unnest(generate_series(e, TIMESTAMP '2001-12-01' - INTERVAL 1 SECOND, INTERVAL 1 MONTH)) AS range_start, 'ADD' AS action FROM f
      UNION ALL
      SELECT 'O', unnest(generate_series(e, TIMESTAMP '2001-12-01' - INTERVAL 1 SECOND, INTERVAL 7 DAYS)), 'SPLIT' FROM o)
    SELECT 'sales' AS schemaname, tablename, strftime(range_start, 'p%Y_%m_%d') AS partition_name, range_start,
      CASE WHEN tablename = 'F' THEN range_start + INTERVAL 1 MONTH ELSE range_start + INTERVAL 7 DAYS END AS range_end, action
    FROM n""",
)
def _extend(spark, sf):
    return extend_partitions(catalog_parts(spark, sf), datetime(2001, 12, 1))


WEEKS = """
weeks AS (SELECT DISTINCT strftime(date_trunc('week', o_orderdate), '_%Y%m%d_') || 'week' AS suffix,
                 date_trunc('week', o_orderdate)::TIMESTAMP AS partition_start FROM orders)"""


@query(
    "retention_select",
    "WITH" + WEEKS
    + """
    SELECT 'orders' || suffix AS partition_name, r.rule FROM weeks, (VALUES
      ('week', date_trunc('week', TIMESTAMP '2001-08-01' - INTERVAL 56 DAYS)),
      ('month', date_trunc('week', TIMESTAMP '2001-08-01' - INTERVAL 2 MONTHS)),
      ('day', date_trunc('day', TIMESTAMP '2001-08-01' - INTERVAL 180 DAYS))) r(rule, cut)
    WHERE partition_start <= r.cut""",
)
def _retention(spark, sf):
    """Retention of 8 weeks, 2 months and 180 days side by side."""
    parts = partition_bounds(orders(spark, sf), "o_orderdate", "week", "orders")
    kept = [
        expired(parts, AS_OF, keep, unit).select("partition_name", F.lit(unit).alias("rule"))
        for keep, unit in ((8, "week"), (2, "month"), (180, "day"))
    ]
    return reduce(DataFrame.unionByName, kept)


@query(
    "prune_run",
    """
    SELECT 'orders_' || strftime(date_trunc('week', o_orderdate), '%Y%m%d') || '_week' AS partition_name,
           count(*) AS n_rows, count(*) AS n_archived, true AS counts_equal, true AS content_equal, true AS safe_to_drop
    FROM orders
    WHERE date_trunc('week', o_orderdate) <= date_trunc('week', TIMESTAMP '2001-08-01' - INTERVAL 56 DAYS)
    GROUP BY 1""",
)
def _prune(spark, sf):
    """Weeks older than eight, archived and proved."""
    return prune_run(orders(spark, sf), work_path(spark, "pruned"), "o_orderdate", "week", "orders", AS_OF, 8, "week")


@query(
    "retention_pairs",
    "WITH" + WEEKS
    + """
    SELECT partition_start, d.drop_order, d.tab || suffix AS partition_name
    FROM weeks, (VALUES (1, 'msg'), (2, 'batch')) d(drop_order, tab)
    WHERE partition_start <= date_trunc('week', TIMESTAMP '2001-08-01' - INTERVAL 56 DAYS)""",
)
def _pairs(spark, sf):
    child = partition_bounds(orders(spark, sf), "o_orderdate", "week", "msg")
    parent = partition_bounds(orders(spark, sf), "o_orderdate", "week", "batch")
    return expired_pairs(child, parent, AS_OF, 8, "week")


@query(
    "quarter_label",
    "SELECT o_orderkey, year(o_orderdate) || 'q' || quarter(o_orderdate) AS label FROM orders",
)
def _label(spark, sf):
    return orders(spark, sf).select("o_orderkey", quarter_label("o_orderdate").alias("label"))


@query(
    "check_not_null",
    """
    SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'P') AS violations FROM orders""",
)
def _not_null(spark, sf):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus")
    return null_count(table(spark, sf, "orders").select(status), "o_orderstatus")


@query(
    "check_primary_key",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _primary(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "check_foreign_key",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def _foreign(spark, sf):
    child = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parent = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("l_orderkey")
    )
    return orphans(child, parent, "l_orderkey")
