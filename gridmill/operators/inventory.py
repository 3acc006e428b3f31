"""Instance inventory kept from daily snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions.rows import row_digest

# States of an inventory row, and the word in the account row that lets
# its new instances in.
CURRENT = "current"
GONE = "deleted"
ACCOUNT_WORD = "safety"

ACCOUNT = ("account_name", "account_number")
INSTANCE = (*ACCOUNT, "instance_name")
IDENTITY = (*INSTANCE, "create_date")


def scd_upsert(
    current: DataFrame,
    snapshot: DataFrame,
    accounts: DataFrame,
    word: str = ACCOUNT_WORD,
    identity: Sequence[str] = IDENTITY,
    account: Sequence[str] = ACCOUNT,
) -> DataFrame:
    """Inventory after a snapshot, with column `change`: insert, update or NULL.

    Unknown instances of accounts whose row holds the word enter as current; known
    ones whose digest differs take the new attributes and keep their state. Identities
    are unique on each side.
    """
    attrs = [c for c in snapshot.columns if c not in identity]
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in accounts.columns])
    allowed = accounts.where(text.contains(word)).select(
        *account, F.lit(True).alias("_allowed")
    ).distinct()
    old = current.select(
        *identity,
        "dba_state",
        F.struct(*attrs).alias("_old"),
        row_digest(attrs).alias("_old_digest"),
    )
    new = snapshot.join(allowed, list(account), "left").select(
        *identity, "_allowed", F.struct(*attrs).alias("_new"), row_digest(attrs).alias("_new_digest")
    )
    unknown, known = F.col("_old").isNull(), F.col("_new").isNotNull()
    change = F.when(unknown & F.col("_allowed"), "insert").when(
        ~unknown & known & (F.col("_old_digest") != F.col("_new_digest")), "update"
    )
    image = F.when(F.col("change").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return (
        old.join(new, list(identity), "full")
        .withColumn("change", change)
        .where(~unknown | (F.col("change") == "insert"))
        .select(
            F.coalesce("dba_state", F.lit(CURRENT)).alias("dba_state"),
            *identity,
            *[image[a].alias(a) for a in attrs],
            "change",
        )
    )


def mark_superseded(
    current: DataFrame,
    inserted: DataFrame,
    instance: Sequence[str] = INSTANCE,
    created: str = "create_date",
) -> DataFrame:
    """Rows older than a newly inserted one of the same instance become deleted."""
    newest = inserted.groupBy(*instance).agg(F.max(created).alias("_newest"))
    older = F.col(created) < F.col("_newest")
    return (
        current.join(newest, list(instance), "left")
        .withColumn("dba_state", F.when(older, GONE).otherwise(F.col("dba_state")))
        .select(*current.columns)
    )


def mark_absent(
    current: DataFrame, snapshot: DataFrame, instance: Sequence[str] = INSTANCE
) -> DataFrame:
    """All rows of an instance become deleted once a current one is not in the snapshot."""
    absent = (
        current.where(F.col("dba_state") == CURRENT)
        .select(*instance)
        .distinct()
        .join(snapshot.select(*instance), list(instance), "left_anti")
        .withColumn("_absent", F.lit(True))
    )
    return (
        current.join(absent, list(instance), "left")
        .withColumn(
            "dba_state", F.when(F.col("_absent"), GONE).otherwise(F.col("dba_state"))
        )
        .select(*current.columns)
    )
