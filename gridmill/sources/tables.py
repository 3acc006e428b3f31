"""Table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def scan(
    spark: SparkSession, path: str, cols: Sequence[str], predicate: Column | str | None = None
) -> DataFrame:
    """Named columns of a Parquet table; the predicate reaches the scan."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*cols)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    cols: Sequence[str],
    predicate: Column | str | None = None,
    *,
    partition_column: str | None = None,
    lower: str | int | None = None,
    upper: str | int | None = None,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """The same from a database, read in parallel ranges of partition_column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower))
            .option("upperBound", str(upper))
            .option("numPartitions", partitions)
        )
    df = reader.load()
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*cols)
