"""Verified archives: partitions may be dropped once what was written is proved to be the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.delimited import line_of


def lines_hash(line: str = "value") -> Column:
    """Order-free hash of a set of lines, as an aggregate."""
    return F.sum(F.xxhash64(line).cast("decimal(38,0)"))


def archive_partition(df: DataFrame, path: str, sep: str = "|") -> DataFrame:
    """Write df compressed, read it back, compare counts and content.

    One row: n_rows, n_archived, counts_equal, content_equal, safe_to_drop. The lines are
    counted and hashed while they are written, so the source is read once, and again as
    they are read back: escapes keep a row on a line, so equal lines are equal rows.
    """
    seen, count = Observation(), F.count(F.lit(1))
    lines = df.select(line_of(df, sep).alias("value"))
    lines.observe(seen, count.alias("n"), lines_hash().alias("h")).write.option("compression", "gzip").text(path)
    source = seen.get
    back = df.sparkSession.read.text(path).agg(count.alias("n_archived"), lines_hash().alias("_h"))
    return back.withColumn("n_rows", F.lit(source["n"]).cast("bigint")).select(
        "n_rows", "n_archived", *_verdict(F.lit(source["h"]).cast("decimal(38,0)"), F.col("_h"))
    )


def archive_partitions(df: DataFrame, path: str, partition: str, sep: str = "|") -> None:
    """Write the rows as lines, compressed, in one folder for each partition, in one job.

    A partition that holds most rows is split over tasks and files, small ones share a
    task. NULL is a partition, too.
    """
    _lines(df, partition, sep).hint("rebalance", partition).write.partitionBy(partition).option(
        "compression", "gzip"
    ).text(path)


def audit_partitions(df: DataFrame, path: str, partition: str, sep: str = "|") -> DataFrame:
    """A row for each partition of df or of the archive, as of archive_partition.

    Both sides are counted and hashed by partition in one pass each, combined before the
    shuffle; a partition that is only in the archive, or not at all, is not safe to drop.
    """
    wanted = _digests(_lines(df, partition, sep), partition, "n_rows", "_h")
    found = _digests(_read(df.sparkSession, path, partition), partition, "n_archived", "_h2")
    both = wanted.join(found.withColumnRenamed(partition, "_found"), F.col(partition).eqNullSafe(F.col("_found")), "full")
    zero = F.lit(0).cast("bigint")
    return both.select(
        F.coalesce(partition, "_found").alias(partition),
        F.coalesce("n_rows", zero).alias("n_rows"),
        F.coalesce("n_archived", zero).alias("n_archived"),
        "_h",
        "_h2",
    ).select(partition, "n_rows", "n_archived", *_verdict(F.col("_h"), F.col("_h2")))


def _verdict(wanted: Column, found: Column) -> list[Column]:
    counts, content = F.col("n_rows") == F.col("n_archived"), wanted.eqNullSafe(found)
    return [counts.alias("counts_equal"), content.alias("content_equal"), (counts & content).alias("safe_to_drop")]


def _lines(df: DataFrame, partition: str, sep: str) -> DataFrame:
    line = line_of(df.drop(partition), sep)
    return df.select(F.col(partition).cast("string").alias(partition), line.alias("value"))


def _read(spark: SparkSession, path: str, partition: str) -> DataFrame:
    return spark.read.schema(f"value string, `{partition}` string").text(path)


def _digests(lines: DataFrame, partition: str, n: str, h: str) -> DataFrame:
    return lines.groupBy(partition).agg(F.count(F.lit(1)).alias(n), lines_hash().alias(h))
