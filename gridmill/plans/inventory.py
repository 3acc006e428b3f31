"""One inventory run: files of instance documents to the kept inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.inventory import mark_absent, mark_superseded, scd_upsert
from gridmill.session import cut_lineage
from gridmill.sources.inventory_json import flatten_inventory


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Instances of the documents under path, one document a line."""
    return flatten_inventory(spark.read.text(path))


def inventory_run(current: DataFrame, snapshot: DataFrame, accounts: DataFrame) -> DataFrame:
    """The inventory after a snapshot, with column `change`.

    Known instances are updated and new ones let in; then rows that a new one replaces,
    and instances that the snapshot no longer has, become deleted.
    """
    # Written once: the new rows are asked for again.
    merged = cut_lineage(scd_upsert(current, snapshot, accounts))
    marked = mark_superseded(merged, merged.where(F.col("change") == "insert"))
    return mark_absent(marked, snapshot)
