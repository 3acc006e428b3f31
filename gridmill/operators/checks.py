"""Checks that stand for table constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    pass


def null_count(df: DataFrame, col: str) -> DataFrame:
    """One row: rows, violations (rows where the column is NULL)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(col).isNull()).alias("violations")
    )


def require_not_null(df: DataFrame, col: str) -> DataFrame:
    """df itself, made to fail in the task that meets a NULL: no extra pass over the data."""
    message = F.lit(f"{col} must not be NULL")
    return df.withColumn(col, F.when(F.col(col).isNull(), F.raise_error(message)).otherwise(F.col(col)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    n = duplicate_keys(df, keys).count()
    if n:
        raise CheckFailed(f"{n} keys occur more than once")


def orphans(
    child: DataFrame, parent: DataFrame, key: str, partition: Sequence[str] = ()
) -> DataFrame:
    """Child rows whose key (in the same partition) is not in the parent.

    A NULL key refers to nothing and is no orphan.
    """
    on = [key, *partition]
    return child.where(F.col(key).isNotNull()).join(parent.select(*on), on, "left_anti")


def require_parents(
    child: DataFrame, parent: DataFrame, key: str, partition: Sequence[str] = ()
) -> None:
    n = orphans(child, parent, key, partition).count()
    if n:
        raise CheckFailed(f"{n} rows refer to a missing {key}")
