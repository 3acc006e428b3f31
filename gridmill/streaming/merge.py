"""Change-capture merge as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridmill.operators.changes import merge_latest, newer_than
from gridmill.operators.latest import latest_changes
from gridmill.operators.tablesync import current_version, expire, publish, read_current
from gridmill.plans.replication import merge_buckets, merge_partitions, touched_buckets, upsert_buckets
from gridmill.session import cut_lineage, path_exists

# Versions that stay of a table that is published whole with every batch.
KEPT = 3
# Buckets of the last changes applied, where the table itself has none.
STATE_BUCKETS = 64


def merge_stream(
    track: DataFrame,
    root: str,
    keys: Sequence[str],
    seq: str,
    checkpoint: str,
    status: str = "status",
    partition: str | None = None,
    buckets: int | None = None,
    state_buckets: int | None = None,
) -> StreamingQuery:
    """Merge the track rows that have arrived into the table, then stop.

    With `buckets`, root is a table of create_buckets and only the buckets of the batch's
    keys are rewritten. With `partition`, root is partitioned by that key column and only
    touched partitions are. With neither, root is a published table and a batch becomes its
    next version, of which the last few stay: for small tables. Either is done before the
    batch's progress is committed: after a failure the batch runs again, and merging it
    twice changes nothing.

    The last change applied to each key, deleted ones too, is kept beside the table, so
    a change that arrives in a later batch than a newer one of its key is left out. It is
    kept in state_buckets buckets by key (as many as the table's, or 64): a batch reads and
    rewrites those of its own keys.
    """
    seen = f"{root.rstrip('/')}.applied"
    places = state_buckets or buckets or STATE_BUCKETS

    def merge_batch(batch: DataFrame, _batch_id: int) -> None:
        spark, now = batch.sparkSession, datetime.now(timezone.utc).replace(tzinfo=None)
        latest = cut_lineage(latest_changes(batch, keys, seq))
        if latest.isEmpty():
            return
        known = path_exists(spark, seen)
        # Written once: it decides on the table and on the state, which both change.
        fresh = latest if not known else cut_lineage(newer_than(latest, touched_buckets(latest, seen, keys, places), keys, seq))
        if fresh.isEmpty():
            return
        if buckets is not None:
            merge_buckets(fresh, root, keys, seq, buckets, status=status)
        elif partition is not None:
            merge_partitions(fresh, root, keys, seq, partition, status=status)
        else:
            version = current_version(spark, root)
            publish(merge_latest(read_current(spark, root), fresh, keys, status), root, now, based_on=version)
            expire(spark, root, KEPT)
        upsert_buckets(fresh.select(*keys, seq), seen, keys, places)

    return (
        track.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
