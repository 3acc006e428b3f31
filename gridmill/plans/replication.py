"""One change-capture batch from acknowledged track rows to the log entry."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.changes import (
    LOG_SCHEMA,
    BatchRange,
    batch_range,
    latest_changes,
    latest_upserts,
    merge_latest,
    reconcile,
    replication_entry,
)
from gridmill.operators.tablesync import (
    Published,
    current_version,
    overwrite_partitions,
    publish,
    read_current,
)
from gridmill.session import cut_lineage, path_exists, remove_path

_BUCKET = "bucket_of_"


@dataclass(frozen=True)
class Batch:
    bounds: BatchRange
    published: Published
    inserts: int
    updates: int
    rows_match: bool
    entry: DataFrame


def replicate(
    track: DataFrame,
    log: DataFrame,
    root: str,
    keys: Sequence[str],
    ack: str,
    source: str,
    target: str,
    as_of: datetime,
    status: str = "status",
) -> Batch | None:
    """Merge the new acknowledged rows into the published table; None when there are none.

    The log entry is for append_log, once the merge is published: a batch that failed is
    repeated. If another writer publishes meanwhile, PublishConflict is raised.
    """
    begun = time.monotonic()
    bounds = batch_range(track, ack, log, target)
    if bounds is None:
        return None
    version = current_version(track.sparkSession, root)
    current = read_current(track.sparkSession, root)
    # Written once: the counts and both sides of the merge read it.
    latest = cut_lineage(latest_changes(track, keys, ack, bounds.last_replicated, bounds.high))
    counts = reconcile(current, latest_upserts(latest, status), keys).first()
    published = publish(merge_latest(current, latest, keys, status), root, as_of, based_on=version)
    elapsed = round(time.monotonic() - begun)
    entry = replication_entry(track, source, target, bounds.high, as_of, elapsed)
    return Batch(bounds, published, counts.inserts, counts.updates, counts.rows_match, entry)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The replication log; empty before the first batch."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def append_log(entry: DataFrame, path: str) -> None:
    entry.select(*read_log(entry.sparkSession, path).columns).write.mode("append").parquet(path)


def replicate_logged(
    track: DataFrame,
    log_path: str,
    root: str,
    keys: Sequence[str],
    ack: str,
    source: str,
    target: str,
    as_of: datetime,
    status: str = "status",
) -> Batch | None:
    """replicate with the log at log_path: read before the batch, appended to after it."""
    log = read_log(track.sparkSession, log_path)
    batch = replicate(track, log, root, keys, ack, source, target, as_of, status)
    if batch is not None:
        append_log(batch.entry, log_path)
    return batch


def merge_partitions(
    track: DataFrame,
    path: str,
    keys: Sequence[str],
    seq: str,
    partition: str,
    low: int | None = None,
    high: int | None = None,
    status: str = "status",
) -> None:
    """Merge changes into a partitioned table on disk, rewriting touched partitions only.

    For tables whose key includes the partition column (a date, as text). What is to be
    put in place is written beside the table first: a try that failed half-way is
    finished by the next call, and merging the same batch again gives the same table.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must be among the keys")
    spark = track.sparkSession
    _finish(spark, path, partition)
    latest = cut_lineage(latest_changes(track, keys, seq, low, high))
    _rewrite(latest, path, partition, lambda current: merge_latest(current, latest, keys, status))


def _rewrite(
    latest: DataFrame, path: str, partition: str, decide: Callable[[DataFrame], DataFrame]
) -> None:
    """Replace the partitions that latest touches by what decide makes of their rows."""
    spark = latest.sparkSession
    touched = latest.select(partition).distinct()
    table = _table(spark, path)
    # Prunes to the touched partitions at run time. A NULL partition is touched as well.
    names = touched.withColumnRenamed(partition, "_touched")
    current = table.join(
        names, F.col(partition).cast("string").eqNullSafe(F.col("_touched").cast("string")), "left_semi"
    ).select(*table.columns)
    touched.write.mode("overwrite").parquet(f"{_pending(path)}/touched")
    decide(current).write.mode("overwrite").parquet(f"{_pending(path)}/rows")
    _finish(spark, path, partition)


def bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """df with a column bucket_of_<buckets>: the number of the bucket of its key.

    Equal keys, NULLs too, fall into one bucket; keys must be of equal types wherever
    they meet.
    """
    return df.withColumn(_bucket_name(buckets), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a table in folders by the hash of its key, for merge_buckets.

    Many enough that a bucket is a file of some hundred megabytes: what a change of one
    key rewrites. The columns are kept beside the table, which may have no row.
    """
    if buckets < 1:
        raise ValueError("buckets must be 1 or more")
    name = _bucket_name(buckets)
    placed = bucket(df, keys, buckets)
    placed.limit(0).write.parquet(_columns(path))
    placed.hint("rebalance", name).write.partitionBy(name).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table, without its bucket column."""
    table = _table(spark, path)
    return table.drop(*[c for c in table.columns if c.startswith(_BUCKET)])


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table; one of create_buckets in its own columns, with or without rows."""
    if not path_exists(spark, _columns(path)):
        return spark.read.parquet(path)
    return spark.read.schema(spark.read.parquet(_columns(path)).schema).parquet(path)


def _columns(path: str) -> str:
    return f"{path.rstrip('/')}.columns"


def merge_buckets(
    track: DataFrame,
    path: str,
    keys: Sequence[str],
    seq: str,
    buckets: int,
    low: int | None = None,
    high: int | None = None,
    status: str = "status",
) -> None:
    """Merge changes into a table of create_buckets, rewriting the touched buckets only.

    A batch of ten keys rewrites ten buckets at most, however large the table is. As
    merge_partitions otherwise: a try that failed is finished by the next call, and the
    same batch again changes nothing.
    """
    spark, name = track.sparkSession, _bucket_name(buckets)
    _same_buckets(spark, path, buckets)
    _finish(spark, path, name)
    latest = cut_lineage(bucket(latest_changes(track, keys, seq, low, high), keys, buckets))
    _rewrite(latest, path, name, lambda current: merge_latest(current, latest, keys, status))


def upsert_buckets(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Put rows, one for a key, in place of those with their keys, or add them."""
    spark, name = rows.sparkSession, _bucket_name(buckets)
    if not path_exists(spark, _columns(path)):
        create_buckets(rows.limit(0), path, keys, buckets)
    _same_buckets(spark, path, buckets)
    _finish(spark, path, name)
    placed = bucket(rows, keys, buckets)
    _rewrite(placed, path, name, lambda current: merge_latest(current, placed.withColumn("_", F.lit("U")), keys, "_"))


def touched_buckets(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows of the table's buckets that hold a key of rows; only those are read."""
    spark, name = rows.sparkSession, _bucket_name(buckets)
    _same_buckets(spark, path, buckets)
    _finish(spark, path, name)
    table = _table(spark, path)
    names = bucket(rows, keys, buckets).select(name).distinct()
    return table.join(names, name, "left_semi").drop(name)


def _same_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    """Rows in other buckets than their keys' would be merged beside themselves."""
    if _bucket_name(buckets) not in _table(spark, path).columns:
        raise ValueError(f"{path} is not in {buckets} buckets")


def _bucket_name(buckets: int) -> str:
    return f"{_BUCKET}{buckets}"


def _pending(path: str) -> str:
    return f"{path.rstrip('/')}.pending"


def _finish(spark: SparkSession, path: str, partition: str) -> None:
    """Put decided partitions in place, if a merge has decided any."""
    pending = _pending(path)
    if not path_exists(spark, f"{pending}/rows/_SUCCESS"):
        return
    rows = spark.read.parquet(f"{pending}/rows")
    overwrite_partitions(rows, path, partition)
    # A partition that lost its last row has nothing to write; its folder goes. Few
    # names: touched partitions with no row left.
    kept = rows.select(F.col(partition).cast("string").alias("_kept")).distinct()
    names = spark.read.parquet(f"{pending}/touched").select(F.col(partition).cast("string").alias("name"))
    for row in names.join(kept, F.col("name").eqNullSafe(F.col("_kept")), "left_anti").collect():
        remove_path(spark, f"{path}/{_folder(spark, partition, row['name'])}")
    remove_path(spark, pending)


def _folder(spark: SparkSession, column: str, value: str | None) -> str:
    """Name of a partition's folder, as Spark writes it."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.getPartitionPathString(column, value)
