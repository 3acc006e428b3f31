"""Where queries register, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.times import hour_bucket, trunc_ntz
from gridmill.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shared inputs: each built once here for Spark and once as a SQL common table.


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as acceptance points: the event type is the unit, minutes the clock."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("bm_unit_id"),
        F.col("user_id").cast("string").alias("acceptance_id"),
        hour_bucket("ts").alias("acceptance_time"),
        F.substring("event_type", 1, 2).alias("ad"),
        F.get_json_object("props", "$.k").cast("int").cast("double").alias("np"),
        trunc_ntz("minute", "ts").alias("time_gmt"),
        (F.col("value").cast("decimal(18,4)") - 10).cast("decimal(18,4)").alias("va_level"),
    )


POINTS = """
points AS (
  SELECT event_type AS bm_unit_id, CAST(user_id AS VARCHAR) AS acceptance_id,
         date_trunc('hour', ts) AS acceptance_time, substr(event_type, 1, 2) AS ad,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS np,
         date_trunc('minute', ts) AS time_gmt,
         CAST(CAST(value AS DECIMAL(18,4)) - 10 AS DECIMAL(18,4)) AS va_level
  FROM events)"""

# Ties of unit and minute: greatest level, then greatest id, time, ad, np.
UNIQUE_POINTS = """
uniq AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY bm_unit_id, time_gmt
      ORDER BY va_level DESC NULLS FIRST, acceptance_id DESC, acceptance_time DESC,
               ad DESC, np DESC) AS rn
    FROM points) WHERE rn = 1)"""

SEGMENTS = """
segments AS (
  SELECT * FROM (
    SELECT bm_unit_id, acceptance_id, acceptance_time, ad, np,
           time_gmt AS from_time, va_level AS from_level,
           lead(time_gmt) OVER w AS to_time, lead(va_level) OVER w AS to_level
    FROM uniq WINDOW w AS (PARTITION BY bm_unit_id ORDER BY time_gmt))
  WHERE to_time IS NOT NULL)"""

MINUTES = """
minutes AS (
  SELECT s.*, m.avg_time
  FROM segments s JOIN (
    SELECT unnest(generate_series((SELECT min(from_time) FROM segments),
                                  (SELECT max(to_time) FROM segments),
                                  INTERVAL 1 MINUTE)) AS avg_time) m
    ON m.avg_time BETWEEN s.from_time AND s.to_time
   AND s.from_time >= m.avg_time - INTERVAL 2 HOURS
   AND s.to_time <= m.avg_time + INTERVAL 2 HOURS
  WHERE s.from_level + s.to_level >= 0)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output per user and hour."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("bm_unit_id"), hour_bucket("ts").alias("avg_datehour"))
        .agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("output"))
    )


HOURLY = """
hourly AS (
  SELECT user_id AS bm_unit_id, date_trunc('hour', ts) AS avg_datehour,
         sum(CAST(value AS DECIMAL(18,4))) AS output
  FROM events GROUP BY 1, 2)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as generating units."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("bm_unit_id"),
        F.col("c_name").alias("station_name"),
        F.col("c_mktsegment").alias("parent_name"),
        F.col("c_acctbal").alias("ef_co2"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("include"),
        (
            F.lit("2024-01-05").cast("timestamp_ntz")
            + F.make_dt_interval(days=F.col("c_nationkey"))
        ).alias("online_date"),
    )


UNITS = """
units AS (
  SELECT c_custkey AS bm_unit_id, c_name AS station_name, c_mktsegment AS parent_name,
         c_acctbal AS ef_co2,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS include,
         TIMESTAMP '2024-01-05' + to_days(c_nationkey) AS online_date
  FROM customer)"""


def coal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as monthly generation and burn of a plant."""
    quantity = F.col("l_quantity").cast("decimal(18,4)")
    burnt = (10 * F.col("l_discount") * F.col("l_quantity")).cast("decimal(18,4)")
    flag = F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("entity_id"),
            F.date_format("l_shipdate", "yyyy-MM").alias("period"),
        )
        .agg(
            F.coalesce(F.sum(F.when(flag == "A", quantity)), F.lit(0)).cast("double").alias("mwh_coal"),
            F.sum(F.when(flag == "N", quantity)).cast("double").alias("mwh_other"),
            F.sum(F.when(flag == "A", burnt)).cast("double").alias("coal_burns"),
        )
    )


COAL = """
coal AS (
  SELECT l_suppkey AS entity_id, strftime(l_shipdate, '%Y-%m') AS period,
    CAST(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS mwh_coal,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) AS mwh_other,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(10 * l_discount * l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) AS coal_burns
  FROM lineitem GROUP BY 1, 2),
rated AS (
  SELECT *,
    CASE WHEN mwh_coal = 0 THEN NULL
         WHEN coal_burns / mwh_coal BETWEEN 0.3::DOUBLE AND 0.9::DOUBLE THEN coal_burns / mwh_coal END AS coal_ratio,
    CASE WHEN mwh_coal + coalesce(mwh_other, 0) = 0 THEN NULL
         ELSE mwh_coal / (mwh_coal + coalesce(mwh_other, 0)) END AS coal_factor
  FROM coal)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
