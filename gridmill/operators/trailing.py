"""Trailing averages.

By hour or month, values are first summed per key and time, so a key's window holds at
most one row per hour (or month) however many rows the key has. By rows, a key's rows are
cut into slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.times import micros, month_index
from gridmill.operators.slices import ROWS, Slices, cut_slices

# The hours and months of the trailing averages.
HOURS = (3, 12, 72)
MONTHS_BACK = 5
_SLICE = "_slice"
_HALO = "_halo"


def trailing_hours_avg(
    hourly: DataFrame,
    unit: str,
    time: str,
    value: str,
    hours: Sequence[int] = HOURS,
    row_mean: str | None = None,
) -> DataFrame:
    """sum(value over (t - N hours, t]) / N for each N, one row per unit and time.

    Times are whole hours: at most 24 rows a day of a unit reach its window.

    The divisor is always N, also where hours are missing. row_mean names a further
    column with the average over the rows of the same unit and time.
    """
    aggs = [F.sum(value).alias(value)]
    if row_mean is not None:
        aggs.append(F.avg(F.col(value).cast("double")).alias(row_mean))
    grid = hourly.groupBy(unit, time).agg(*aggs)
    frame = Window.partitionBy(unit).orderBy(micros(time))
    hour = 3_600_000_000
    return grid.select(
        *grid.columns,
        *[
            (F.sum(value).over(frame.rangeBetween(1 - n * hour, 0)).cast("double") / n).alias(
                f"avg{n}hour"
            )
            for n in hours
        ],
    )


def trailing_rows_avg(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    rows: Sequence[int] = HOURS,
    slices: Slices | None = None,
) -> DataFrame:
    """Average over the last N rows of the key for each N; decimals are summed exactly.

    Needs one row per key and order value. A key's rows of one slice are one window, to
    which the last N - 1 rows of the key's slices before it are added, so a key with all
    rows is spread over all slices. row_slices() cuts them, on df unless given.
    """
    if slices is None:
        slices = row_slices(df, order)
    own = slices.numbered(df, _late(order), _SLICE)
    sliced = own if slices.count == 1 else own.withColumn(_HALO, F.lit(False)).unionByName(
        _halo(own, keys, order, value, max(rows) - 1), allowMissingColumns=True
    )
    frame = Window.partitionBy(*keys, _SLICE).orderBy(F.col(order).asc_nulls_last())

    def mean(n: int) -> Column:
        last = frame.rowsBetween(1 - n, 0)
        total, seen = F.sum(value).over(last).cast("double"), F.count(value).over(last)
        return total / F.nullif(seen, F.lit(0))

    out = sliced.select("*", *[mean(n).alias(f"avg{n}rows") for n in rows])
    if slices.count > 1:
        out = out.where(~F.col(_HALO)).drop(_HALO)
    return out.drop(_SLICE)


def row_slices(df: DataFrame, order: str, per_slice: int = ROWS) -> Slices:
    """Slices for trailing_rows_avg; any table with like values of the order does."""
    return cut_slices(df, _late(order), per_slice)


def _late(order: str) -> Column:
    """The order with NULL last."""
    return F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"))


def _halo(own: DataFrame, keys: Sequence[str], order: str, value: str, n: int) -> DataFrame:
    """The last n rows of a key before each of its slices, numbered as rows of that slice.

    A slice gives its last n rows; those of the n slices of the key before a slice hold
    the n rows before it, as none is empty. So no window holds more than n * n rows.
    """
    if n < 1:
        return own.limit(0).withColumn(_HALO, F.lit(True))
    at = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"), F.col(value).alias("v"))
    backwards = Window.partitionBy(*keys, _SLICE).orderBy(F.col(order).desc_nulls_first())
    last = own.select(*keys, _SLICE, at.alias("r"), F.row_number().over(backwards).alias("back")).where(F.col("back") <= n)
    ends = last.groupBy(*keys, _SLICE).agg(F.sort_array(F.collect_list("r")).alias("ends"))
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(-n, -1)
    rows = F.flatten(F.collect_list("ends").over(before))
    given = ends.select(*keys, _SLICE, rows.alias("rows"))
    return given.select(
        *keys, _SLICE, F.explode(F.slice("rows", F.greatest(F.size("rows") - n, F.lit(0)) + 1, n)).alias("r")
    ).select(*keys, _SLICE, F.col("r.at").alias(order), F.col("r.v").alias(value), F.lit(True).alias(_HALO))


def trailing_months_avg(
    df: DataFrame, entity: str, period: str, values: Sequence[str], back: int = MONTHS_BACK
) -> DataFrame:
    """Average of each value over the current and `back` previous calendar months.

    All rows of the entity in those months count; a missing month does not widen the
    frame. The average is NULL where entity or period is NULL. Adds <value>_avg.
    """
    aggs = []
    for v in values:
        aggs += [F.sum(v).alias(f"_s_{v}"), F.count(v).alias(f"_n_{v}")]
    months = df.groupBy(entity, period).agg(*aggs)
    frame = Window.partitionBy(entity).orderBy(month_index(period)).rangeBetween(-back, 0)
    averages = months.select(
        F.col(entity).alias("_entity"),
        F.col(period).alias("_period"),
        *[
            (F.sum(f"_s_{v}").over(frame) / F.nullif(F.sum(f"_n_{v}").over(frame), F.lit(0))).alias(
                f"_avg_{v}"
            )
            for v in values
        ],
    )
    # A null-safe join keeps both sides of the plan alike, so an input that was itself
    # aggregated is computed once.
    same = F.col(entity).eqNullSafe(F.col("_entity")) & F.col(period).eqNullSafe(F.col("_period"))
    has_both = F.col(entity).isNotNull() & F.col(period).isNotNull()
    return df.join(averages, same).select(
        *df.columns, *[F.when(has_both, F.col(f"_avg_{v}")).alias(f"{v}_avg") for v in values]
    )
