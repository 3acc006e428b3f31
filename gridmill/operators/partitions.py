"""Time partitions: names, bounds, calendar extension and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.times import micros, trunc_ntz
from gridmill.operators.latest import latest_rank_rows

INTERVALS = ("week", "month")
# Lengths in days that stand for one calendar month.
MONTH_DAYS = (27, 31)
DAY_SECONDS = 86_400


def route(df: DataFrame, col: str, interval: str, table: str) -> DataFrame:
    """Adds partition_name (table_YYYYMMDD_week, a week starts on Monday) and partition_start."""
    start = _start(col, interval)
    name = F.concat(
        F.lit(table), F.date_format(start, "'_'yyyyMMdd'_'"), F.lit(interval)
    )
    return df.withColumn("partition_start", start).withColumn("partition_name", name)


def route_quarter(df: DataFrame, col: str, table: str) -> DataFrame:
    """Adds partition_name (table_YYYY_Qn)."""
    name = F.concat(
        F.lit(f"{table}_"),
        F.year(col).cast("string"),
        F.lit("_Q"),
        F.quarter(col).cast("string"),
    )
    return df.withColumn("partition_name", name)


def partition_bounds(df: DataFrame, col: str, interval: str, table: str) -> DataFrame:
    """The distinct partitions of the rows with their half-open range."""
    step = F.expr(f"INTERVAL 1 {_checked(interval).upper()}")
    return (
        route(df.select(col), col, interval, table)
        .select("partition_name", "partition_start")
        .distinct()
        .withColumn("partition_end", (F.col("partition_start") + step).cast("timestamp_ntz"))
    )


def write_routed(df: DataFrame, path: str, col: str, interval: str, table: str) -> None:
    """Append the rows under one directory per partition.

    Rebalanced by partition: one that holds most rows is split over tasks and files of
    the advisory size, small ones are packed together.
    """
    routed = route(df, col, interval, table).drop("partition_start")
    routed.hint("rebalance", "partition_name").write.mode("append").partitionBy(
        "partition_name"
    ).parquet(path)


def extend_partitions(parts: DataFrame, needed_end: datetime) -> DataFrame:
    """New partitions that carry each table's calendar up to needed_end.

    parts: schemaname, tablename, partitionrank, partitionrangestart, partitionrangeend,
    partitiontype, partitionisdefault. The step is the length of the last range; 27 to
    31 days mean a month. Tables that are not range partitioned by time are skipped.
    """
    table = ["schemaname", "tablename"]
    defaults = parts.groupBy(*table).agg(
        F.coalesce(F.max("partitionisdefault"), F.lit(False)).alias("_default")
    )
    ranges = parts.where(~F.coalesce("partitionisdefault", F.lit(False)))
    start, end = F.col("partitionrangestart"), F.col("partitionrangeend")
    needed = F.lit(needed_end).cast("timestamp_ntz")
    last = (
        latest_rank_rows(ranges, table, "partitionrank")
        .where(F.col("partitiontype").contains("range") & start.isNotNull() & (end > start))
        .where(end < needed)
        .withColumn(
            "_step", F.call_function("div", micros(end) - micros(start), F.lit(1_000_000))
        )
        .withColumn("_days", F.call_function("div", F.col("_step"), F.lit(DAY_SECONDS)))
        .withColumn("_month", F.col("_days").between(*MONTH_DAYS))
        .withColumn("_step", F.col("_step") - F.col("_step") % 60)
        .where(F.col("_month") | (F.col("_step") > 0))
    )
    gap = F.call_function("div", micros(needed) - micros(end), F.lit(1_000_000))
    # Enough steps for either kind; those past the need are dropped below.
    months = F.ceil(F.months_between(needed, end)) + 1
    steps = F.when(F.col("_month"), months).otherwise(F.ceil(gap / F.col("_step")) + 1)
    made = last.withColumn("_k", F.explode(F.sequence(F.lit(1), steps.cast("int"))))
    k = F.col("_k")
    new_start = F.when(F.col("_month"), _plus_months(start, k)).otherwise(
        _plus_seconds(end, F.col("_step") * (k - 1))
    )
    new_end = F.when(F.col("_month"), _plus_months(end, k)).otherwise(
        _plus_seconds(end, F.col("_step") * k)
    )
    before = F.when(F.col("_month"), _plus_months(end, k - 1)).otherwise(
        _plus_seconds(end, F.col("_step") * (k - 1))
    )
    hourly = F.col("_step") % DAY_SECONDS >= 3600
    name = F.when(hourly, F.date_format("range_start", "'p'yyyy_MM_dd_HH")).otherwise(
        F.date_format("range_start", "'p'yyyy_MM_dd")
    )
    return (
        made.where(before < needed)
        .withColumn("range_start", new_start)
        .withColumn("range_end", new_end)
        .join(defaults, table)
        .select(
            *table,
            name.alias("partition_name"),
            "range_start",
            "range_end",
            F.when(F.col("_default"), "SPLIT").otherwise("ADD").alias("action"),
        )
    )


def cutoff(as_of: datetime, keep: int, unit: str) -> Column:
    """The newest partition date that has expired: as_of less `keep` units.

    Weeks and months count back to the start of a week.
    """
    t = F.lit(as_of).cast("timestamp_ntz")
    if unit in ("week", "month"):
        return trunc_ntz("week", t - F.expr(f"INTERVAL {int(keep)} {unit.upper()}S"))
    if unit == "day":
        return trunc_ntz("day", t - F.expr(f"INTERVAL {int(keep)} DAYS"))
    raise ValueError(f"unit must be day, week or month, not {unit}")


def expired(
    parts: DataFrame, as_of: datetime, keep: int, unit: str, date: str = "partition_start"
) -> DataFrame:
    """Partitions at or before the cutoff."""
    return parts.where(F.col(date) <= cutoff(as_of, keep, unit))


def expired_pairs(
    child: DataFrame,
    parent: DataFrame,
    as_of: datetime,
    keep: int,
    unit: str,
    date: str = "partition_start",
    name: str = "partition_name",
) -> DataFrame:
    """Expired child partitions and the parents of the same date, each child first.

    A dry list: nothing is dropped.
    """
    old = expired(child, as_of, keep, unit, date).select(date, F.col(name).alias("_child"))
    pairs = old.join(parent.select(date, F.col(name).alias("_parent")), date)
    both = F.array(
        F.struct(F.lit(1).alias("drop_order"), F.col("_child").alias(name)),
        F.struct(F.lit(2).alias("drop_order"), F.col("_parent").alias(name)),
    )
    return pairs.select(date, F.inline(both)).orderBy(date, "drop_order")


def _plus_months(ts: Column, n: Column) -> Column:
    return (ts + F.make_ym_interval(F.lit(0), n)).cast("timestamp_ntz")


def _plus_seconds(ts: Column, n: Column) -> Column:
    return F.timestamp_micros(micros(ts) + n * 1_000_000).cast("timestamp_ntz")


def _start(col: str, interval: str) -> Column:
    return trunc_ntz(_checked(interval), col)


def _checked(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be week or month, not {interval}")
    return interval
