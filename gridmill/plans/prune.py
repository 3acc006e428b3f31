"""Retention: expired partitions are archived, proved, and listed as safe to drop."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.operators.partitions import cutoff, route
from gridmill.sources.archive import archive_partitions, audit_partitions


def expired_rows(
    df: DataFrame, col: str, interval: str, table: str, as_of: datetime, keep: int, unit: str
) -> DataFrame:
    """Rows of the expired partitions, with partition_name. The limit reaches the scan."""
    last = cutoff(as_of, keep, unit)
    # No row of an expired partition is later than one interval after the cutoff.
    early = df.where(F.col(col) < (last + F.expr(f"INTERVAL 1 {interval.upper()}")).cast("timestamp_ntz"))
    routed = route(early, col, interval, table)
    return routed.where(F.col("partition_start") <= last).drop("partition_start")


def prune_run(
    df: DataFrame,
    path: str,
    col: str,
    interval: str,
    table: str,
    as_of: datetime,
    keep: int,
    unit: str,
    sep: str = "|",
) -> DataFrame:
    """Archive all expired partitions under path; an audit row for each.

    partition_name, n_rows, n_archived, counts_equal, content_equal, safe_to_drop. One job
    writes all partitions, one reads both sides. Nothing is dropped; `droppable` lists
    what may be. path must be new: a failed run is repeated under another.
    """
    old = expired_rows(df, col, interval, table, as_of, keep, unit)
    archive_partitions(old, path, "partition_name", sep)
    return audit_partitions(old, path, "partition_name", sep)


def droppable(audit: DataFrame) -> DataFrame:
    """Names of the partitions that the audit has proved, in order."""
    return audit.where("safe_to_drop").select("partition_name").orderBy("partition_name")
