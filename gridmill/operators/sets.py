"""Ordering, unions and manifest comparison."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.rows import pg_order


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """Order by several columns, '-' for descending, NULLs as PostgreSQL places them."""
    return df.orderBy(*pg_order(*cols))


def ordered_union(parts: Sequence[DataFrame], name: str, text: str) -> DataFrame:
    """Distinct union of the parts tagged 1, 2, .. as cmd_order, ordered by name, tag, text."""
    tagged = [p.withColumn("cmd_order", F.lit(i + 1)) for i, p in enumerate(parts)]
    union = reduce(DataFrame.unionByName, tagged).distinct()
    return union.orderBy(*pg_order(name, "cmd_order", text))


def missing_files(
    local: DataFrame,
    remote: DataFrame,
    name: str,
    modified: str,
    since: datetime,
    suffix: str = ".gpg",
) -> DataFrame:
    """Recent local names without their remote copy, copy for copy."""
    recent = local.where(F.col(modified) > F.lit(since).cast("timestamp_ntz")).select(base_name(name))
    bare = remote.select(F.regexp_replace(name, F.lit(_literal(suffix) + "$"), F.lit("")).alias(name))
    return recent.exceptAll(bare).where(F.length(name) > 0)


def base_name(name: str) -> Column:
    """The part of a path after its last slash."""
    return F.substring_index(name, "/", -1).alias(name)


def manifest_mismatch(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Names that the two lists hold a different number of times; empty when they match."""
    one = a.select(name, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    two = b.select(name, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    sides = one.unionByName(two).groupBy(name)
    return sides.agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")).where(
        F.col("in_a") != F.col("in_b")
    )


def manifests_equal(a: DataFrame, b: DataFrame, name: str) -> bool:
    return manifest_mismatch(a, b, name).isEmpty()


def missing_pieces(expected: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Expected pieces that are not present."""
    return expected.join(present.select(name).distinct(), name, "left_anti")


def require_all(expected: DataFrame, present: DataFrame, name: str) -> None:
    """Fail when any expected piece is missing."""
    n = missing_pieces(expected, present, name).count()
    if n:
        raise ValueError(f"{n} expected pieces are missing")


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)
