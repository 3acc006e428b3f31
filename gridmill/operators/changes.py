"""Change tracking and change-capture merge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.operators.latest import latest_changes
from gridmill.operators.slices import ROWS, cut_slices, sums_before

# Fixed value: the status that marks a deleted row in the track log.
DELETED = "D"
LOG_SCHEMA = (
    "source_tablename string, target_tablename string, last_row_replicated long,"
    " last_row_replicated_timestamp timestamp_ntz, batch_elapsed_seconds long"
)


def acknowledge(
    track: DataFrame,
    keys: Sequence[str],
    seq: str,
    ack: str,
    ack_time: str,
    last: int,
    as_of: datetime,
    per_slice: int = ROWS,
) -> DataFrame:
    """Number the rows not yet acknowledged last+1, last+2, .. in order of seq.

    Rows without a sequence come last, in order of the keys, as do rows of one sequence.
    The order is cut into slices of about per_slice rows at splitters from a sample; rows
    are ranked inside their slice, and slices are offset by the counts before them. So no
    task ranks more than one slice, whether rows have a sequence or not.
    """
    fresh = track.where(F.col(ack).isNull())
    order = [F.col(seq).isNull().alias("_late"), F.col(seq), *[F.col(k) for k in keys]]
    rows = cut_slices(fresh, F.struct(*order), per_slice).numbered(fresh, F.struct(*order), "_slice")
    counts = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_before"))
    offsets = sums_before(counts, [], "_slice", ["_before"], levels=1)
    inside = Window.partitionBy("_slice").orderBy(F.col(seq).isNull(), seq, *keys)
    numbered = (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_slice")
        .withColumn(ack, F.lit(last) + F.coalesce("_before", F.lit(0)) + F.col("_rn"))
        .withColumn(ack_time, F.lit(as_of).cast("timestamp_ntz"))
        .select(*track.columns)
    )
    return track.where(F.col(ack).isNotNull()).unionByName(numbered)


@dataclass(frozen=True)
class BatchRange:
    low: int
    high: int

    @property
    def last_replicated(self) -> int:
        return self.low - 1

    @property
    def length(self) -> int:
        return self.high - self.last_replicated


def batch_bounds(track: DataFrame, ack: str, log: DataFrame, target: str) -> DataFrame:
    """One row: low, high, has_new. An empty log replicates from the start."""
    done = log.where(F.col("target_tablename") == target).agg(
        F.coalesce(F.max("last_row_replicated"), F.lit(0)).alias("_last")
    )
    newest = track.agg(F.max(ack).alias("high"))
    return done.join(newest, F.lit(True)).select(
        (F.col("_last") + 1).alias("low"),
        "high",
        F.coalesce(F.col("high") > F.col("_last"), F.lit(False)).alias("has_new"),
    )


def batch_range(track: DataFrame, ack: str, log: DataFrame, target: str) -> BatchRange | None:
    """The numbers to replicate next, or None when nothing is new."""
    row = batch_bounds(track, ack, log, target).first()
    return BatchRange(row.low, row.high) if row.has_new else None


def latest_deletes(latest: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Keys whose latest change is a delete."""
    return latest.where(F.col(status) == DELETED).select(*keys)


def latest_upserts(latest: DataFrame, status: str = "status") -> DataFrame:
    """Latest changes that are not deletes; a NULL status is neither."""
    return latest.where(F.col(status) != DELETED)


def apply_deletes(target: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(deletes.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target with the changed rows put in place of the old ones, or added."""
    kept = target.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes.select(*target.columns))


def merge_changes(
    target: DataFrame,
    track: DataFrame,
    keys: Sequence[str],
    seq: str,
    low: int | None = None,
    high: int | None = None,
    status: str = "status",
) -> DataFrame:
    """Target after the changes low < seq <= high: deletes, then updates and inserts.

    The same batch again gives the same target.
    """
    return merge_latest(target, latest_changes(track, keys, seq, low, high), keys, status)


def merge_latest(
    target: DataFrame, latest: DataFrame, keys: Sequence[str], status: str = "status"
) -> DataFrame:
    """Target after the latest change of each key.

    One anti join serves deletes and updates, since a key has one latest change; a small
    batch is broadcast and the target stays put. NULL key values match each other, so
    that a batch can be repeated. Changes without a status are left out.
    """
    known = latest.where(F.col(status).isNotNull())
    changed = known.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    kept = target.join(changed, same, "left_anti")
    return kept.unionByName(latest_upserts(known, status).select(*target.columns))


def newer_than(
    latest: DataFrame, applied: DataFrame, keys: Sequence[str], seq: str
) -> DataFrame:
    """Changes later than the last one applied to their key.

    applied(keys, seq) has the keys of deleted rows, too: a change that arrives late does
    not bring them back.
    """
    known = applied.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(seq).alias("_seq"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    later = F.col("_seq").isNull() | (F.col(seq) > F.col("_seq"))
    return latest.join(known, same, "left").where(later).select(*latest.columns)


def replication_entry(
    latest: DataFrame,
    source: str,
    target: str,
    high: int,
    as_of: datetime,
    elapsed_seconds: int,
) -> DataFrame:
    """The log row of a finished batch."""
    return latest.sparkSession.createDataFrame(
        [(source, target, high, as_of, elapsed_seconds)], LOG_SCHEMA
    )


def next_log(
    log: DataFrame, track: DataFrame, ack: str, source: str, target: str, as_of: datetime
) -> DataFrame:
    """The log and the row that a batch of the track's new rows adds to it; none, if none are new."""
    entry = (
        batch_bounds(track, ack, log, target)
        .where("has_new")
        .select(
            F.lit(source).alias("source_tablename"),
            F.lit(target).alias("target_tablename"),
            F.col("high").alias("last_row_replicated"),
            F.lit(as_of).cast("timestamp_ntz").alias("last_row_replicated_timestamp"),
            F.lit(0).cast("long").alias("batch_elapsed_seconds"),
        )
    )
    return log.unionByName(entry)


def reconcile(
    target: DataFrame, upserts: DataFrame, keys: Sequence[str], length: int | None = None
) -> DataFrame:
    """One row: batch rows against the keys they insert and update.

    Needs the target as it was before the merge, which is only searched for the batch's
    keys. The counts differ where the batch repeats a key.
    """
    batch = upserts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    found = F.coalesce("_known", F.lit(False)).cast("long")
    out = (
        batch.join(known, list(keys), "left")
        .agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("batch_rows"),
            F.coalesce(F.sum(1 - found), F.lit(0)).alias("inserts"),
            F.coalesce(F.sum(found), F.lit(0)).alias("updates"),
        )
        .withColumn("rows_match", F.col("batch_rows") == F.col("inserts") + F.col("updates"))
    )
    return out if length is None else out.withColumn("batch_range", F.lit(length))


def snapshot_diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str], user: str
) -> DataFrame:
    """Track rows between two states of a table: I and U with the new image, D with the old.

    Keys are unique in each state. Columns: those of the table, status, userid.
    """
    cols = new.columns
    rest = [c for c in cols if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_old"))
    n = new.select(*keys, F.struct(*rest).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "I")
        .when(F.col("_new").isNull(), DELETED)
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "U")
    )
    image = F.coalesce("_new", "_old")
    return (
        o.join(n, list(keys), "full")
        .withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(
            *[c if c in keys else image[c].alias(c) for c in cols],
            "status",
            F.lit(user).alias("userid"),
        )
    )
