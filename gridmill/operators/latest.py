"""Latest record per key, each with its own tie rule.

All of them combine before the shuffle, so a hot key costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Per key, the column-wise maximum over the rows with the greatest order value.

    Values may come from different tied rows. A key whose order values are all NULL
    gives one row of NULLs.
    """
    pairs = [F.max(F.struct(order, c)).alias(f"_{i}") for i, c in enumerate(cols)]
    picked = df.groupBy(*keys).agg(F.max(order).alias(order), *pairs)
    return picked.select(
        *keys,
        order,
        *[
            F.when(F.col(order).isNotNull(), F.col(f"_{i}")[c]).alias(c)
            for i, c in enumerate(cols)
        ],
    )


def dedup(df: DataFrame, keys: Sequence[str], prefer: str, cols: Sequence[str] = ()) -> DataFrame:
    """One row per key: the greatest `prefer`, where NULL counts as the greatest.

    Further ties fall to the greatest cols.
    """
    best = F.max(F.struct(F.col(prefer).isNull().alias("_null"), prefer, *cols)).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *keys, *[F.col("_best")[c].alias(c) for c in (prefer, *cols)]
    )


def latest_changes(
    track: DataFrame, keys: Sequence[str], seq: str, low: int | None = None, high: int | None = None
) -> DataFrame:
    """The row with the highest sequence per key among low < seq <= high."""
    rows = track
    if low is not None:
        rows = rows.where(F.col(seq) > F.lit(low))
    if high is not None:
        rows = rows.where(F.col(seq) <= F.lit(high))
    others = [c for c in track.columns if c not in keys]
    rest = [c for c in others if c != seq]
    newest = F.max(F.struct(seq, *rest)).alias("_row")
    picked = rows.where(F.col(seq).isNotNull()).groupBy(*keys).agg(newest)
    return picked.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in track.columns])


def latest_rank_rows(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """All rows that carry the highest rank of their key."""
    top = df.groupBy(*keys).agg(F.max(rank).alias(rank))
    return df.join(top, [*keys, rank], "left_semi")


def latest_group_values(df: DataFrame, date: str, cols: Sequence[str]) -> DataFrame:
    """The distinct values on the newest date."""
    newest = df.agg(F.max(date)).scalar()
    return df.where(F.col(date) == newest).select(date, *cols).distinct()
