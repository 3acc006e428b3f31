"""Run history of scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions.times import micros


def run_history(
    events: DataFrame,
    keys: Sequence[str],
    state: str,
    time: str,
    start_cols: Sequence[str] = (),
    end_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per START; the last END of the same keys closes it if it came later.

    Columns: keys, start_cols, start_datetime, end_datetime, status, run_seconds and
    the end_cols (return code, message) of that END.
    """
    starts = events.where(F.col(state) == "START").select(
        *keys, *start_cols, F.col(time).alias("start_datetime")
    )
    ends = (
        events.where(F.col(state) == "END")
        .groupBy(*keys)
        .agg(F.max(F.struct(F.col(time).alias("_t"), *end_cols)).alias("_end"))
    )
    closed = F.col("_end._t") >= F.col("start_datetime")
    return starts.join(ends, list(keys), "left").select(
        *keys,
        *start_cols,
        "start_datetime",
        F.when(closed, F.col("_end._t")).alias("end_datetime"),
        F.when(closed, "END").otherwise("START").alias("status"),
        F.when(closed, (micros("_end._t") - micros("start_datetime")) / F.lit(1_000_000)).alias(
            "run_seconds"
        ),
        *[F.when(closed, F.col("_end")[c]).alias(c) for c in end_cols],
    )
