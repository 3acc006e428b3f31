"""Joins, aggregates, ordering and manifests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.catalog.registry import query, table
from gridmill.operators.aggregates import (
    capacity_report,
    count_audit,
    data_max,
    over_threshold,
    watermark,
)
from gridmill.operators.graph import create_order, dependency_closure
from gridmill.operators.joins import exclude, latest_backup_pieces, semi
from gridmill.operators.latest import latest_group_values, latest_rank_rows
from gridmill.operators.sets import (
    manifest_mismatch,
    missing_files,
    missing_pieces,
    ordered,
    ordered_union,
)


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query(
    "semi_tuple_in",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE (l_partkey, l_suppkey) IN (
      SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _semi(spark, sf):
    lines = table(spark, sf, "lineitem")
    returned = lines.where(F.col("l_returnflag") == "R")
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return semi(rows, returned, ["l_partkey", "l_suppkey"])


@query(
    "not_in_anti",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def _not_in(spark, sf):
    blocked = table(spark, sf, "customer").where(F.col("c_acctbal") < 0)
    return exclude(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), blocked, "o_custkey", "c_custkey"
    )


@query(
    "nested_semi_latest",
    """
    WITH jobs AS (
      SELECT o_orderkey AS session_key, c_nationkey AS db_key, o_orderdate AS end_time,
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'COMPLETED WITH WARNINGS' ELSE 'FAILED' END AS status
      FROM orders JOIN customer ON o_custkey = c_custkey),
    sets AS (
      SELECT l_orderkey AS session_key, db_key, l_orderkey * 10 + l_linenumber AS bs_key,
        l_linenumber - 1 AS incremental_level, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'I' END AS backup_type
      FROM lineitem JOIN jobs ON l_orderkey = session_key),
    newest AS (
      SELECT j.db_key, max(j.end_time) AS end_time FROM jobs j
      JOIN sets s ON j.db_key = s.db_key AND j.session_key = s.session_key
      WHERE j.status LIKE 'COMPLETED%'
        AND ((s.incremental_level = 0 AND s.backup_type = 'I') OR s.backup_type = 'D')
      GROUP BY 1)
    SELECT DISTINCT s.db_key, 'p' || l_partkey || '.bak' AS piece, l_shipdate AS completion_time
    FROM lineitem l JOIN sets s ON l.l_orderkey * 10 + l.l_linenumber = s.bs_key
    JOIN jobs j ON j.session_key = s.session_key
    JOIN newest n ON n.db_key = j.db_key AND n.end_time = j.end_time""",
)
def _backup(spark, sf):
    """Orders as backup jobs of a nation's database, line items as their sets and pieces."""
    jobs = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("session_key"),
            F.col("c_nationkey").alias("db_key"),
            F.col("o_orderdate").alias("end_time"),
            F.when(F.col("o_orderstatus") == "F", "COMPLETED")
            .when(F.col("o_orderstatus") == "O", "COMPLETED WITH WARNINGS")
            .otherwise("FAILED")
            .alias("status"),
            F.lit("DB INCR").alias("input_type"),
        )
    )
    lines = table(spark, sf, "lineitem").withColumn(
        "bs_key", F.col("l_orderkey") * 10 + F.col("l_linenumber")
    )
    sets = (
        lines.join(jobs, F.col("l_orderkey") == F.col("session_key"))
        .select(
            "bs_key",
            "session_key",
            "db_key",
            (F.col("l_linenumber") - 1).alias("incremental_level"),
            F.when(F.col("l_returnflag") == "R", "D").otherwise("I").alias("backup_type"),
        )
    )
    pieces = lines.select(
        "bs_key",
        F.concat(F.lit("/backup/"), F.col("l_suppkey"), F.lit("/p"), F.col("l_partkey"), F.lit(".bak")).alias("handle"),
        F.col("l_shipdate").alias("completion_time"),
    )
    sites = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("db_key"), F.col("n_name").alias("db_unique_name")
    )
    return latest_backup_pieces(jobs, sets, pieces, sites, once=True)


CAPACITY = """
WITH files AS (
  SELECT p_brand AS tablespace_name, CASE WHEN p_size > 25 THEN 'YES' ELSE 'NO' END AS autoextensible,
         CAST(p_size AS BIGINT) * 1048576 AS maxbytes, CAST(p_retailprice * 1024 AS BIGINT) AS bytes FROM part),
segs AS (
  SELECT p_brand AS tablespace_name, CAST(l_quantity AS BIGINT) * 40000 AS bytes
  FROM lineitem JOIN part ON l_partkey = p_partkey),
da AS (SELECT tablespace_name, CAST(sum(CASE WHEN autoextensible = 'YES' THEN maxbytes ELSE bytes END) AS BIGINT) AS data_max
       FROM files GROUP BY 1),
tb AS (SELECT tablespace_name, CAST(sum(bytes) AS BIGINT) AS used FROM segs GROUP BY 1),
report AS (
  SELECT da.tablespace_name, round(used / 1048576.0::DOUBLE, 1) AS used_mb,
         round(data_max / 1048576.0::DOUBLE, 1) AS total_mb,
         round(CAST(used AS DOUBLE) / data_max * 100, 1) AS percent_used,
         round(data_max / 1048576.0::DOUBLE - used / 1048576.0::DOUBLE, 1) AS free_mb
  FROM da JOIN tb ON da.tablespace_name = tb.tablespace_name
  WHERE da.tablespace_name NOT LIKE 'UNDO%')
"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("tablespace_name"),
        F.when(F.col("p_size") > 25, "YES").otherwise("NO").alias("autoextensible"),
        (F.col("p_size").cast("bigint") * 1048576).alias("maxbytes"),
        F.round(F.col("p_retailprice") * 1024).cast("bigint").alias("bytes"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Summed per part first, so that the join moves one row per part."""
    used = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum(F.col("l_quantity").cast("bigint") * 40000).alias("bytes"))
    )
    return used.join(table(spark, sf, "part"), "p_partkey").select(
        F.col("p_brand").alias("tablespace_name"), "bytes"
    )


@query("agg_join_agg", CAPACITY + "SELECT * FROM report")
def _capacity(spark, sf):
    return capacity_report(files(spark, sf), segments(spark, sf))


@query("conditional_sum", CAPACITY + "SELECT * FROM da")
def _data_max(spark, sf):
    return data_max(files(spark, sf))


@query(
    "usage_threshold",
    CAPACITY
    + """
    SELECT *, 'Tablespace ' || tablespace_name || ' is at ' || percent_used || ' Percent USED!' AS warning
    FROM report WHERE percent_used >= 90""",
)
def _threshold(spark, sf):
    return over_threshold(capacity_report(files(spark, sf), segments(spark, sf)))


@query(
    "dependency_closure",
    """
    WITH RECURSIVE edges AS (
      SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child
      FROM region JOIN nation ON r_regionkey = n_regionkey
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
      UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem
      UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation),
    walk AS (
      SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region
      UNION SELECT e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node
      WHERE e.parent <> e.child)
    SELECT node, max(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1""",
)
def _closure(spark, sf):
    """Regions to nations to suppliers and customers, suppliers to parts."""

    def node(tag: str, col: str):
        return F.concat(F.lit(tag), F.col(col).cast("string"))

    def edge(name: str, parent, child) -> DataFrame:
        return table(spark, sf, name).select(parent.alias("parent"), child.alias("child"))

    edges = (
        edge("nation", node("r", "n_regionkey"), node("n", "n_nationkey"))
        .unionByName(edge("supplier", node("n", "s_nationkey"), node("s", "s_suppkey")))
        .unionByName(edge("customer", node("n", "c_nationkey"), node("c", "c_custkey")))
        .unionByName(edge("lineitem", node("s", "l_suppkey"), node("p", "l_partkey")))
        .unionByName(edge("nation", node("n", "n_nationkey"), node("n", "n_nationkey")))
    )
    roots = table(spark, sf, "region").select(node("r", "r_regionkey").alias("node"))
    return create_order(dependency_closure(edges, roots))


@query(
    "row_count_audit",
    """
    SELECT s.n AS source_count, t.n AS target_count, s.n = t.n AS counts_match
    FROM (SELECT count(*) AS n FROM orders) s,
         (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) t""",
)
def _audit(spark, sf):
    return count_audit(
        table(spark, sf, "orders"), table(spark, sf, "lineitem").select("l_orderkey").distinct()
    )


@query("high_watermark", "SELECT max(l_shipdate) AS watermark FROM lineitem")
def _watermark(spark, sf):
    return watermark(table(spark, sf, "lineitem"), "l_shipdate")


@query(
    "latest_rank_rows",
    """
    WITH parts AS (
      SELECT o_orderpriority AS schemaname, o_orderstatus AS tablename,
             strftime(o_orderdate, '%Y-%m') AS partitionrank, CAST(count(*) AS BIGINT) AS n
      FROM orders GROUP BY 1, 2, 3)
    SELECT * FROM parts WHERE (schemaname, tablename, partitionrank) IN (
      SELECT (schemaname, tablename, max(partitionrank)) FROM parts GROUP BY schemaname, tablename)""",
)
def _latest_rank(spark, sf):
    parts = (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("schemaname"),
            F.col("o_orderstatus").alias("tablename"),
            F.date_format("o_orderdate", "yyyy-MM").alias("partitionrank"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return latest_rank_rows(parts, ["schemaname", "tablename"], "partitionrank")


@query(
    "latest_group_values",
    """
    SELECT DISTINCT o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year,
      CAST(weekofyear(o_orderdate) AS INTEGER) AS week
    FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""",
)
def _latest_group(spark, sf):
    dated = table(spark, sf, "orders").select(
        "o_orderdate", F.year("o_orderdate").alias("year"), F.weekofyear("o_orderdate").alias("week")
    )
    return latest_group_values(dated, "o_orderdate", ["year", "week"])


@query("multi_key_sort", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier")
def _sort(spark, sf):
    return ordered(
        table(spark, sf, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey"),
        "s_nationkey", "-s_acctbal", "s_suppkey",
    )


@query(
    "union_distinct_ordinal",
    """
    SELECT c_mktsegment AS name, 1 AS cmd_order, 'begin ' || c_mktsegment AS command FROM customer
    UNION
    SELECT c_mktsegment, 2, 'copy ' || c_name FROM customer
    UNION
    SELECT c_mktsegment, 3, 'end ' || c_mktsegment FROM customer""",
)
def _ordinal(spark, sf):
    c = table(spark, sf, "customer")

    def part(word: str, col: str) -> DataFrame:
        return c.select(
            F.col("c_mktsegment").alias("name"), F.concat(F.lit(word), F.col(col)).alias("command")
        )

    parts = [part("begin ", "c_mktsegment"), part("copy ", "c_name"), part("end ", "c_mktsegment")]
    return ordered_union(parts, "name", "command")


@query(
    "manifest_difference",
    """
    SELECT 'o' || o_orderkey || '.gz' AS name FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'
    EXCEPT ALL
    SELECT 'o' || l_orderkey || '.gz' FROM lineitem""",
)
def _difference(spark, sf):
    local = table(spark, sf, "orders").select(
        F.concat(F.lit("/archive/o"), F.col("o_orderkey"), F.lit(".gz")).alias("name"), "o_orderdate"
    )
    remote = table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(".gz.gpg")).alias("name")
    )
    return missing_files(local, remote, "name", "o_orderdate", datetime(1998, 1, 1))


@query(
    "manifest_match",
    """
    SELECT coalesce(a.k, b.k) AS name, CAST(coalesce(a.n, 0) AS BIGINT) AS in_a, CAST(coalesce(b.n, 0) AS BIGINT) AS in_b
    FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k
    WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def _match(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"))
    return manifest_mismatch(a, b, "name")


@query(
    "manifest_missing",
    "SELECT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _missing(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"))
    return missing_pieces(a, b, "name")
