"""Sources, sinks, projections and masking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.catalog.registry import query, table
from gridmill.functions.masking import mask_email, mask_secret, md5_pair
from gridmill.operators.aggregates import active_items
from gridmill.operators.joins import find_instances
from gridmill.session import work_path
from gridmill.sources.archive import archive_partition
from gridmill.sources.delimited import export_delimited, load_delimited, to_lines
from gridmill.sources.documents import read_documents, split_documents, write_documents
from gridmill.sources.inventory_json import flatten_inventory
from gridmill.sources.messages import parse_acceptance_messages
from gridmill.sources.tables import scan


@query(
    "scan_project",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01'""",
)
def _scan(spark, sf):
    since = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    return scan(spark, f"{sf}/orders.parquet", cols, since)


LOAD_SCHEMA = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)


@query(
    "delimited_load",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag, l_shipdate FROM lineitem",
)
def _load(spark, sf):
    path = work_path(spark, "preload")
    lines = table(spark, sf, "lineitem")
    export_delimited(lines.select(*LOAD_SCHEMA.names), path, sep=",")
    return load_delimited(spark, path, LOAD_SCHEMA).rows


@query(
    "delimited_export",
    """
    SELECT o_orderkey || '|' || o_custkey || '|' || coalesce(nullif(o_orderstatus, 'F'), '\\N') || '|'
           || o_orderpriority AS line FROM orders""",
)
def _export(spark, sf):
    path = work_path(spark, "export")
    status = F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("o_orderstatus")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", status, "o_orderpriority")
    export_delimited(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "line_export",
    """
    SELECT o_orderkey || ',' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || ','
           || nullif(o_orderstatus, 'P') || ',' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS line
    FROM orders""",
)
def _lines(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
    )
    return to_lines(rows, rows.columns, order=["o_orderdate", "o_orderkey"])


@query(
    "verified_archive",
    """
    SELECT count(*) AS n_rows, count(*) AS n_archived, true AS counts_equal,
           true AS content_equal, true AS safe_to_drop FROM lineitem""",
)
def _archive(spark, sf):
    return archive_partition(table(spark, sf, "lineitem"), work_path(spark, "archive"))


@query(
    "message_parse",
    """
    SELECT 'U-' || user_id AS bm_unit_id, CAST(event_id AS VARCHAR) AS acceptance_id, 'F' AS so,
           date_trunc('hour', ts) AS acceptance_time, upper(substr(event_type, 1, 1)) AS ad,
           CAST(2 AS DOUBLE) AS np,
           date_trunc('second', ts) + to_minutes(CAST(30 * i AS INTEGER)) AS time_gmt,
           CAST(CAST(value AS DECIMAL(18,4)) + i AS DOUBLE) AS va_level
    FROM events, (VALUES (0), (1)) p(i)""",
)
def _messages(spark, sf):
    """Every event as a message with two points, written as text and parsed back."""
    fmt = "yyyy:MM:dd:HH:mm:ss"
    level = F.col("value").cast("decimal(18,4)")
    later = F.col("ts") + F.expr("INTERVAL 30 MINUTES")
    text = F.concat(
        F.date_format("ts", fmt),
        F.lit(":GMT: subject=X.BM.U-"),
        F.col("user_id").cast("string"),
        F.lit(".BOALF, message={NK="),
        F.col("event_id").cast("string"),
        F.lit(",SO=F,TA="),
        F.date_format(F.date_trunc("hour", "ts"), fmt),
        F.lit(":GMT,AD="),
        F.upper(F.substring("event_type", 1, 1)),
        F.lit(",NP=2,TS="),
        F.date_format("ts", fmt),
        F.lit(":GMT,VA="),
        level.cast("string"),
        F.lit(",TS="),
        F.date_format(later, fmt),
        F.lit(":GMT,VA="),
        (level + 1).cast("string"),
        F.lit("}"),
    )
    path = work_path(spark, "messages")
    table(spark, sf, "events").select(text.alias("value")).write.text(path)
    out = parse_acceptance_messages(spark.read.text(path))
    return out.withColumns({c: F.col(c).cast("double") for c in ("np", "va_level")})


@query(
    "json_flatten",
    """
    SELECT c_mktsegment AS account_name, CAST(n_regionkey AS VARCHAR) AS account_number,
           c_name AS instance_name, '2024-01-01 00:00:00 UTC' AS create_date, r_name AS region,
           n_name AS engine, '9.6' AS version, c_acctbal > 0 AS auto_update,
           c_acctbal > 5000 AS is_multi_zone, 'h' || c_custkey || '.example' AS endpoint,
           '5432' AS port, 'admin' AS master_user, 'small' AS db_class,
           CAST(CAST(1000 + abs(c_acctbal) AS DECIMAL(18,2)) AS DOUBLE) AS ppm,
           CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS pph,
           true AS is_active
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _json(spark, sf):
    """Customers as inventory documents of one instance each."""
    c = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    balance = F.col("c_acctbal")
    month = F.concat(F.lit("$"), F.format_number((F.abs(balance) + 1000).cast("decimal(18,2)"), 2))
    hour = F.when(balance < 0, "").otherwise(
        F.concat(F.lit("$"), F.format_number(balance.cast("decimal(18,2)"), 2))
    )
    doc = F.array(
        F.struct(
            F.struct(
                F.col("c_mktsegment").alias("name"),
                F.col("n_regionkey").cast("string").alias("owner_id"),
            ).alias("account"),
            F.col("c_name").alias("instance_id"),
            F.lit("2024-01-01 00:00:00 UTC").alias("create_date"),
            F.struct(F.col("r_name").alias("name")).alias("region"),
            F.col("n_name").alias("engine"),
            F.lit("9.6").alias("version"),
            (balance > 0).alias("auto_update"),
            (balance > 5000).alias("is_multi_zone"),
            F.concat(F.lit("h"), F.col("c_custkey"), F.lit(".example:5432")).alias("endpoint"),
            F.lit("admin").alias("username"),
            F.lit("small").alias("flavor"),
            month.alias("price_per_month"),
            hour.alias("hourly_cost"),
            F.lit(True).alias("is_active"),
        )
    )
    out = flatten_inventory(c.select(F.to_json(doc).alias("value")))
    return out.withColumns({n: F.col(n).cast("double") for n in ("ppm", "pph")})


def order_documents(lines: DataFrame) -> DataFrame:
    """Each line item as a document: two items, allocated to one and to two ship-tos.

    The first item is allocated to the supplier twice; the second time counts.
    """
    ship, other = F.col("l_suppkey"), F.col("l_suppkey") + 1
    quantity = F.col("l_quantity").cast("int")

    def alloc(to, qty):
        start = F.rpad(F.lit("Z2EDP01SDQ"), 211, " ")
        return F.concat(start, F.rpad(qty.cast("string"), 10, " "), to.cast("string"))

    def item(no, part):
        start = F.rpad(F.concat(F.lit(f"E2EDP010{no:02d} "), part.cast("string")), 74, " ")
        return F.concat(start, F.rpad(F.lit("0"), 15, " "), F.lit(f"END{no}"))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("EDI_DC40 "), F.col("l_orderkey").cast("string")),
        F.rpad(F.lit("E2EDKA1001WE"), 75, "x"),
        item(1, F.col("l_partkey")),
        F.lit("E2EDP19001 text"),
        alloc(ship, F.lit(0)),
        alloc(ship, quantity),
        item(2, F.col("l_partkey") + 1),
        alloc(ship, quantity + 1),
        alloc(other, F.col("l_linenumber")),
        F.lit("E2EDS01 END"),
    )
    return lines.select("l_orderkey", text.alias("text"))


@query(
    "idoc_split",
    """
    WITH d AS (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
    s AS (SELECT *, l_suppkey AS ship, 1 AS no FROM d UNION ALL SELECT *, l_suppkey + 1, 2 FROM d)
    SELECT l_orderkey, CAST(ship AS VARCHAR) AS ship_to, no AS ship_to_no,
      'EDI_DC40 ' || l_orderkey || chr(10)
      || rpad(rpad('E2EDKA1001WE', 65, 'x'), 83, ' ') || ship || chr(10)
      || CASE WHEN no = 1 THEN rpad('E2EDP01001 ' || l_partkey, 74, ' ') || rpad(CAST(q AS VARCHAR), 15, ' ')
           || 'END1' || chr(10) || 'E2EDP19001 text' || chr(10) ELSE '' END
      || rpad('E2EDP01002 ' || (l_partkey + 1), 74, ' ')
      || rpad(CAST(CASE WHEN no = 1 THEN q + 1 ELSE l_linenumber END AS VARCHAR), 15, ' ') || 'END2' || chr(10)
      || 'E2EDS01 END' AS text
    FROM s""",
)
def _idoc(spark, sf):
    """Written as files of documents and read back."""
    path = work_path(spark, "documents")
    write_documents(order_documents(table(spark, sf, "lineitem")), path)
    number = F.regexp_extract("text", "^EDI_DC40 ([0-9]+)", 1).cast("long")
    docs = read_documents(spark, path).drop("file")
    return split_documents(docs.select(number.alias("l_orderkey"), "text"))


@query(
    "mask_email",
    """
    WITH e AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN
      lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' END AS email FROM customer)
    SELECT c_custkey, CASE WHEN email = 'customer.000000007@machinery.example' THEN email
      ELSE replace(email, '@', '_at_') || '@company.com' END AS email FROM e""",
)
def _email(spark, sf):
    email = F.when(
        F.col("c_acctbal") >= 0,
        F.concat(
            F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
            F.lit("@"),
            F.lower("c_mktsegment"),
            F.lit(".example"),
        ),
    )
    c = table(spark, sf, "customer").select("c_custkey", email.alias("email"))
    return c.select(
        "c_custkey",
        mask_email("email", allow=["customer.000000007@machinery.example"]).alias("email"),
    )


@query(
    "mask_secret",
    """
    SELECT c_custkey, CASE WHEN c_name IN ('Customer#000000003') THEN c_mktsegment
      ELSE sha256('4:salt' || strlen(c_name) || ':' || c_name || c_mktsegment) END AS secret FROM customer""",
)
def _secret(spark, sf):
    masked = mask_secret("c_name", "c_mktsegment", "salt", allow=["Customer#000000003"])
    return table(spark, sf, "customer").select("c_custkey", masked.alias("secret"))


@query(
    "digest_columns",
    "SELECT c_custkey, 'md5' || md5(c_mktsegment || c_name) AS digest FROM customer",
)
def _digest(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", md5_pair("c_mktsegment", "c_name").alias("digest")
    )


@query(
    "substring_lookup",
    """
    SELECT c_name AS instance_name,
      'psql -h ' || host || ' -p 5432 -d ' || CASE WHEN host LIKE '%RedShift%' THEN 'padb_harvest' ELSE 'postgres' END
      || ' -U admin' AS connect
    FROM (SELECT *, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'RedShift.example' ELSE 'db.example' END AS host FROM customer)
    WHERE c_name LIKE '%9%' AND c_acctbal >= 0""",
)
def _lookup(spark, sf):
    host = F.when(F.col("c_mktsegment") == "MACHINERY", "RedShift.example").otherwise("db.example")
    rows = table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") >= 0, "current").otherwise("deleted").alias("dba_state"),
        F.col("c_name").alias("instance_name"),
        host.alias("endpoint"),
        F.lit("5432").alias("port"),
        F.lit("admin").alias("master_user"),
    )
    return find_instances(rows, "9", "padb_harvest", "postgres")


@query(
    "active_duration",
    """
    SELECT (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1000000.0 AS running_seconds,
           event_type || ' ' || props AS query, event_id FROM (
      SELECT * REPLACE (regexp_replace(props, '\\s+', ' ', 'g') AS props) FROM events)
    WHERE event_type NOT IN ('error', 'click')""",
)
def _active(spark, sf):
    text = F.when(F.col("event_type") == "error", "<IDLE>").when(
        F.col("event_type") != "click",
        F.concat(F.col("event_type"), F.lit(" \t\n "), F.col("props")),
    )
    e = table(spark, sf, "events").select("event_id", "ts", text.alias("query"))
    return active_items(e, "ts", "query", datetime(2024, 1, 31), cols=["event_id"])
