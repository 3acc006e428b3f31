"""Table synchronisation.

The first functions give the rows to append; the publishing ones write a new version
of a table and switch to it by appending to its version log, so a reader never sees a
half-written table and a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.times import day_window
from gridmill.operators.aggregates import watermark_value
from gridmill.operators.joins import selected_units
from gridmill.session import create_empty, names_in, remove_path

_LOG = "version long, rows long, published timestamp_ntz"


def append_newer(
    src: DataFrame, dst: DataFrame, col: str, bootstrap: bool = False
) -> DataFrame:
    """Source rows strictly later than the newest target value.

    An empty target has no newest value, so nothing is loaded unless bootstrap is set.
    """
    newest = watermark_value(dst, col)
    later = F.col(col) > newest
    return src.where(later | newest.isNull()) if bootstrap else src.where(later)


def new_since(
    src: DataFrame, dst: DataFrame, load_time: str, time: str, day: date
) -> DataFrame:
    """Source rows of one day that were loaded after the target's last load."""
    return append_newer(day_window(src, time, day), dst, load_time)


def append_if_newer(src: DataFrame, dst: DataFrame, col: str) -> DataFrame:
    """Target plus the later source rows; an empty target stays empty."""
    return dst.unionByName(append_newer(src, dst, col).select(*dst.columns))


def reload_day(src: DataFrame, dst: DataFrame, col: str, day: date) -> DataFrame:
    """Target without the day, then with all later source rows."""
    start = F.lit(day).cast("timestamp_ntz")
    end = start + F.expr("INTERVAL 1 DAY")
    kept = dst.where((F.col(col) < start) | (F.col(col) >= end) | F.col(col).isNull())
    return append_if_newer(src, kept, col)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that df holds, and no others, in a table on disk.

    The form of reload_day for a table partitioned by day: run again, it gives the same.
    df must not read the table itself.
    """
    df.hint("rebalance", partition).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition).parquet(path)


def zero_fill(
    daily: DataFrame,
    units: DataFrame,
    unit: str,
    day: str,
    value: str,
    period_cols: Sequence[str],
    unit_cols: Sequence[str] = (),
    skip: Sequence[str] = (),
) -> DataFrame:
    """Rows of value 0 for selected units absent on the newest day.

    They carry that day and its period columns, all from one row of the day (the
    greatest), and unit_cols of the unit. Units in skip get none.
    """
    newest = daily.agg(F.max(day)).scalar()
    present = daily.where(F.col(day) == newest)
    period = present.groupBy(day).agg(F.max(F.struct(*period_cols)).alias("_p")).select(day, "_p.*")
    absent = (
        units.join(selected_units(units, unit, skip), unit, "left_semi")
        .select(unit, *unit_cols)
        .join(present.select(unit), unit, "left_anti")
    )
    zero = F.lit(0).cast(daily.schema[value].dataType)
    # Every row meets the one row of the newest day.
    return absent.join(period, F.lit(True)).withColumn(value, zero)


@dataclass(frozen=True)
class Published:
    version: int
    source_count: int
    target_count: int


class CountMismatch(RuntimeError):
    pass


class PublishConflict(RuntimeError):
    """Another writer has published since the version that the change is based on."""


def logged_versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions that still can be read, oldest first. Few: `expire` bounds them."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{root}/log")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    there = set(_written(spark, root))
    return sorted(v for v in {r.version for r in log.select("version").distinct().collect()} if v in there)


def current_version(spark: SparkSession, root: str) -> int | None:
    try:
        log = spark.read.schema(_LOG).parquet(f"{root}/log")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return log.agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The table as last published."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/version={version}")


def publish(
    df: DataFrame,
    root: str,
    as_of: datetime,
    partition_by: Sequence[str] = (),
    based_on: int | None = None,
) -> Published:
    """Write df as a new version, compare counts, and only then switch to it.

    The version number is claimed first, so two writers never write one version; a number
    once claimed is never used again, and what a failed try has written is never read. The highest published number is current.
    based_on names the version that df was made from: if another has been published by the
    time df is written, nothing is switched and PublishConflict is raised, so the change can
    be made again. The source count is observed while writing, so df runs once.
    """
    spark = df.sparkSession
    # The first publication starts an empty log; later ones leave it alone.
    spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{root}/log")
    version = _claim(spark, root)
    path = f"{root}/version={version}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    source, target = seen.get["n"], spark.read.parquet(path).count()
    if source != target:
        raise CountMismatch(f"{source} source rows, {target} in {path}")
    now = current_version(spark, root)
    if based_on is not None and now != based_on:
        raise PublishConflict(f"{root} is at version {now}, the change is based on {based_on}")
    entry = spark.createDataFrame([(version, target, as_of)], _LOG)
    entry.write.mode("append").parquet(f"{root}/log")
    return Published(version, source, target)


def _claim(spark: SparkSession, root: str) -> int:
    """A number that no other writer has: claimed by a file of its own name, and held only
    if no other claim for the number is there once it is written.

    Of two writers at least the later to look sees the other, so never both hold a number,
    on any file system that lists what has been written; both may let it go and try again.
    """
    for attempt in count():
        version = max([current_version(spark, root) or 0, *_claimed(spark, root)]) + 1
        create_empty(spark, f"{root}/claims/{version}.{uuid.uuid4().hex}")
        if _claimed(spark, root).count(version) == 1:
            return version
        time.sleep(random.random() * min(2**attempt, 32) / 32)
    raise AssertionError


def _claimed(spark: SparkSession, root: str) -> list[int]:
    return [int(n.partition(".")[0]) for n in names_in(spark, f"{root}/claims")]


def _written(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removeprefix("version=")) for n in names_in(spark, root) if n.startswith("version=")]


def expire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Remove the versions before the `keep` newest published ones; return their numbers.

    keep: as many as readers may still be reading, the current one among them. What failed
    tries have left below the oldest kept version goes, too; anything above it may be a
    try that still runs and stays.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    kept = logged_versions(spark, root)[-keep:]
    old = sorted(v for v in _written(spark, root) if kept and v < kept[0])
    for version in old:
        remove_path(spark, f"{root}/version={version}")
    for name in names_in(spark, f"{root}/claims"):
        if kept and int(name.partition(".")[0]) < kept[0]:
            remove_path(spark, f"{root}/claims/{name}")
    return old


def full_refresh(src: DataFrame, root: str, as_of: datetime) -> Published:
    """Replace the target by the source and report both counts."""
    return publish(src, root, as_of)


@dataclass(frozen=True)
class Appended:
    before: object
    after: object
    rows: int


def append_to_table(
    src: DataFrame, path: str, col: str, bootstrap: bool = False
) -> Appended:
    """Append the newer source rows to a Parquet table; the same run again adds none."""
    spark = src.sparkSession
    dst = spark.read.parquet(path)
    before = dst.agg(F.max(col).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if before.m is None and not bootstrap:
        return Appended(None, None, 0)
    # The watermark as a literal: fixed before the table changes, and pushed to the scan.
    newer = src if before.m is None else src.where(F.col(col) > F.lit(before.m))
    newer.select(*dst.columns).write.mode("append").parquet(path)
    after = spark.read.parquet(path).agg(F.max(col).alias("m"), F.count(F.lit(1)).alias("n")).first()
    return Appended(before.m, after.m, after.n - before.n)
