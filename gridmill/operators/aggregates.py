"""Grouped sums and counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.times import micros

# The share of a tablespace at which to warn, names left out of the
# report, bytes in a MB.
WARN_PERCENT = 90
UNDO_PATTERN = "UNDO%"
MB = 1024 * 1024


def group_avg(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Average of each value; rows that a join repeated collapse."""
    return df.groupBy(*keys).agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values])


def data_max(files: DataFrame, name: str = "tablespace_name") -> DataFrame:
    """Bytes each tablespace can grow to."""
    size = F.when(F.col("autoextensible") == "YES", F.col("maxbytes")).otherwise(F.col("bytes"))
    return files.groupBy(name).agg(F.sum(size).alias("data_max"))


def capacity_report(
    files: DataFrame, segments: DataFrame, name: str = "tablespace_name"
) -> DataFrame:
    """Used, total, percent and free per tablespace, in MB to one place."""
    used = segments.groupBy(name).agg(F.sum("bytes").alias("used"))
    sized = data_max(files, name).join(used, name).where(~F.col(name).like(UNDO_PATTERN))
    u, total = F.col("used").cast("double"), F.col("data_max").cast("double")
    return sized.select(
        name,
        F.round(u / MB, 1).alias("used_mb"),
        F.round(total / MB, 1).alias("total_mb"),
        F.round(F.when(total != 0, u / total) * 100, 1).alias("percent_used"),
        F.round(total / MB - u / MB, 1).alias("free_mb"),
    )


def over_threshold(
    report: DataFrame, percent: float = WARN_PERCENT, name: str = "tablespace_name"
) -> DataFrame:
    """Rows at or above the threshold, with the warning text."""
    text = F.concat(
        F.lit("Tablespace "),
        F.col(name),
        F.lit(" is at "),
        F.col("percent_used").cast("string"),
        F.lit(" Percent USED!"),
    )
    return report.where(F.col("percent_used") >= percent).withColumn("warning", text)


def active_items(
    df: DataFrame,
    start: str,
    text: str,
    as_of: datetime,
    idle: str = "<IDLE>",
    cols: Sequence[str] = (),
) -> DataFrame:
    """What is running at as_of, longest first: running_seconds, text on one line, cols."""
    seconds = (micros(F.lit(as_of).cast("timestamp_ntz")) - micros(start)) / F.lit(1_000_000)
    return (
        df.where(F.col(text).isNotNull() & (F.col(text) != idle))
        .select(
            seconds.alias("running_seconds"),
            F.regexp_replace(text, r"\s+", " ").alias(text),
            *cols,
        )
        .orderBy(F.col("running_seconds").desc_nulls_first(), text, *cols)
    )


def count_audit(src: DataFrame, dst: DataFrame) -> DataFrame:
    """One row: source_count, target_count, counts_match."""
    return counts(src, "source_count").join(counts(dst, "target_count"), F.lit(True)).withColumn(
        "counts_match", F.col("source_count") == F.col("target_count")
    )


def counts(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def watermark(df: DataFrame, col: str) -> DataFrame:
    """One row: the greatest value of the column, as `watermark`."""
    return df.agg(F.max(col).alias("watermark"))


def watermark_value(df: DataFrame, col: str) -> Column:
    """The same as a scalar inside another query, pushed to its scan as a literal."""
    return df.agg(F.max(col)).scalar()
