"""Points, segments and the sums between them.

No operator here puts all rows of one key into one task: rows are grouped by key and
slice, and slices are joined up.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.times import trunc_ntz
from gridmill.operators.slices import ROWS, Slices, cut_slices, link_neighbours, sums_before

_SLICE = "_slice"
_FIRST = "_first"


def lead_segments(
    points: DataFrame,
    keys: Sequence[str],
    time: str,
    level: str,
    carry: Sequence[str] = (),
    slices: Slices | None = None,
) -> DataFrame:
    """Join every point to the next one of its key; the open last point is dropped.

    Columns: keys, from_time, from_level, carry (of the from point), to_time, to_level.
    Points at the same time follow in order of level, then carry. One key's points of one
    slice are ordered in one task; point_slices() cuts them, on points unless given.
    """
    if slices is None:
        slices = point_slices(points, time, level, carry)
    row = ["from_time", "from_level", *carry]
    # A point with no time sorts last: it starts no segment and ends none.
    timed = points.where(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("from_time"), F.col(level).alias("from_level"), *carry
    )
    p = slices.numbered(timed, F.struct(*row), _SLICE)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*[F.col(c).asc_nulls_first() for c in row])
    led = p.withColumns(
        {
            "to_time": F.lead("from_time").over(inside),
            "to_level": F.lead("from_level").over(inside),
            _FIRST: F.row_number().over(inside) == 1,
        }
    )
    inner = led.where(F.col("to_time").isNotNull()).drop(_SLICE, _FIRST)
    if slices.count == 1:
        return inner
    # The last point of a slice joins the first point of the key's next slice.
    point, last = F.struct(*row), F.col("to_time").isNull()
    ends = (
        led.where(F.col(_FIRST) | last)
        .groupBy(*keys, _SLICE)
        .agg(F.max(F.when(F.col(_FIRST), point)).alias("head"), F.max(F.when(last, point)).alias("tail"))
    )
    links = [
        pairs.select(
            *keys,
            "tail.*",
            F.col("next.from_time").alias("to_time"),
            F.col("next.from_level").alias("to_level"),
        )
        for pairs in link_neighbours(ends, keys, _SLICE, 1)
    ]
    return reduce(DataFrame.unionByName, links, inner)


def point_slices(
    points: DataFrame, time: str, level: str, carry: Sequence[str] = (), per_slice: int = ROWS
) -> Slices:
    """Slices of points for lead_segments; points before or after dedup do."""
    return cut_slices(points.where(F.col(time).isNotNull()), F.struct(time, level, *carry), per_slice)


def nonneg_levels(
    df: DataFrame, from_level: str = "from_level", to_level: str = "to_level"
) -> DataFrame:
    """Segments whose mean level is not negative."""
    return df.where(F.col(from_level) + F.col(to_level) >= 0)


def minute_grid(
    segments: DataFrame,
    from_time: str = "from_time",
    to_time: str = "to_time",
    reach_hours: int = 2,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Every whole minute a segment covers (both ends count), as column avg_time.

    A minute sees a segment only if it starts and ends within reach_hours of it.
    start and end clip the grid and reach the scan. A generator per row, no shuffle;
    a row makes at most 60 * reach_hours + 1 rows.
    """
    reach = F.expr(f"INTERVAL {int(reach_hours)} HOURS")
    f, t = F.col(from_time), F.col(to_time)
    low, high = F.greatest(f, t - reach), F.least(t, f + reach)
    seg = segments
    if start is not None:
        s = F.lit(start).cast("timestamp_ntz")
        seg = seg.where((t >= s) & (f >= s - reach))
        low = F.greatest(low, s)
    if end is not None:
        e = F.lit(end).cast("timestamp_ntz")
        seg = seg.where((f <= e) & (t <= e + reach))
        high = F.least(high, e)
    minute = F.expr("INTERVAL 1 MINUTE")
    floor_low = trunc_ntz("minute", low)
    first = F.when(floor_low < low, floor_low + minute).otherwise(floor_low)
    return (
        seg.where(f.isNotNull() & t.isNotNull())
        .withColumn("_first", first)
        .withColumn("_last", trunc_ntz("minute", high))
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("avg_time", F.explode(F.sequence("_first", "_last", minute)))
        .drop("_first", "_last")
    )


def override_energy(
    schedule: DataFrame,
    readings: DataFrame,
    unit: str,
    from_time: str,
    to_time: str,
    energy: str,
    reading_time: str,
    reading_level: str,
    group: Sequence[str] = (),
    slices: Slices | None = None,
) -> DataFrame:
    """Scheduled energy replaced by the sum of the unit's readings in [from, to].

    Rows equal in unit, from, to, energy and group collapse into one, and their
    matched sum counts once per collapsed row. Columns: the keys, matched (NULL with
    no reading), output = coalesce(matched, energy).

    The sum between two moments is the difference of two running sums, so readings
    and segments are never paired and the work stays linear for a hot unit. Sums are
    exact decimals. moment_slices() cuts the moments, those of both inputs unless given.
    """
    keys = list(dict.fromkeys([unit, from_time, to_time, energy, *group]))
    groups = schedule.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    reads = (
        readings.where(F.col(unit).isNotNull() & F.col(reading_time).isNotNull())
        .groupBy(unit, F.col(reading_time).alias("_t"))
        .agg(
            F.sum(exact(readings, reading_level)).alias("_s"),
            F.count(reading_level).alias("_n"),
        )
    )
    if slices is None:
        starts_and_ends = schedule.select(F.explode(F.array(from_time, to_time)).alias("_t"))
        both = starts_and_ends.unionByName(readings.select(F.col(reading_time).alias("_t")))
        slices = moment_slices(both, "_t")
    # At one moment: segment starts (0), readings (1), segment ends (2).
    probes = groups.select(
        *keys,
        "_copies",
        F.explode(
            F.array(
                F.struct(F.col(from_time).alias("_t"), F.lit(0).alias("_side")),
                F.struct(F.col(to_time).alias("_t"), F.lit(2).alias("_side")),
            )
        ).alias("_p"),
    ).select(*keys, "_copies", "_p.*", F.xxhash64(*keys).alias("_tie"))
    both = probes.unionByName(
        reads.withColumns({"_side": F.lit(1), "_tie": F.xxhash64(unit)}), allowMissingColumns=True
    )
    stream = slices.numbered(both, _moment(F.col("_t"), F.col("_side"), F.col("_tie")), _SLICE)

    inside = (
        Window.partitionBy(unit, _SLICE)
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = (
        stream.withColumn("_s", F.sum("_s").over(inside))
        .withColumn("_n", F.sum("_n").over(inside))
        .where(F.col("_side") != 1)
    )
    zero = F.lit(0).cast("decimal(38,18)")
    total_s, total_n = F.coalesce("_s", zero), F.coalesce("_n", F.lit(0))
    if slices.count > 1:
        running = running.join(
            _read_before(schedule, readings, slices, unit, from_time, to_time, reading_time, reading_level, keys),
            [unit, _SLICE],
            "left",
        )
        total_s, total_n = total_s + F.coalesce("_s0", zero), total_n + F.coalesce("_n0", F.lit(0))
    sign = F.when(F.col("_side") == 2, 1).otherwise(-1)
    summed = running.groupBy(*keys, "_copies").agg(
        F.sum(F.when(F.col("_side") == 2, total_s).otherwise(-total_s)).alias("_s"),
        F.sum(sign * total_n).alias("_n"),
    )
    in_order = F.col(from_time).isNotNull() & F.col(to_time).isNotNull() & (F.col("_n") > 0)
    return summed.withColumn(
        "matched", F.when(in_order, F.col("_s").cast("double") * F.col("_copies"))
    ).select(*keys, "matched", F.coalesce("matched", energy).alias("output"))


def _read_before(
    schedule: DataFrame,
    readings: DataFrame,
    slices: Slices,
    unit: str,
    from_time: str,
    to_time: str,
    reading_time: str,
    reading_level: str,
    keys: Sequence[str],
) -> DataFrame:
    """(unit, slice, _s0, _n0): sum and count of the unit's readings in earlier slices.

    Straight from the inputs, combined before the shuffle; a unit has at most as many
    rows as there are slices.
    """
    none, tie = F.lit(None).cast("decimal(38,18)"), F.xxhash64(*keys)
    ends = F.array(_moment(F.col(from_time), F.lit(0), tie), _moment(F.col(to_time), F.lit(2), tie))
    touched = schedule.select(unit, F.explode(ends).alias("_at"), none.alias("_s"))
    read = readings.where(F.col(reading_time).isNotNull()).select(
        unit,
        _moment(F.col(reading_time), F.lit(1), F.xxhash64(unit)).alias("_at"),
        exact(readings, reading_level).alias("_s"),
    )
    totals = (
        slices.numbered(touched.unionByName(read), F.col("_at"), _SLICE)
        .where(F.col(unit).isNotNull())
        .groupBy(unit, _SLICE)
        .agg(F.sum("_s").alias("_s0"), F.count("_s").alias("_n0"))
    )
    return sums_before(totals, [unit], _SLICE, ["_s0", "_n0"], 1)


def moment_slices(df: DataFrame, time: str, per_slice: int = ROWS) -> Slices:
    """Slices of moments for override_energy, by the times of df, its other columns as ties."""
    known = df.where(F.col(time).isNotNull())
    return cut_slices(known, _moment(F.col(time), F.lit(0), F.xxhash64(*df.columns)), per_slice)


def _moment(time: Column, side: Column, tie: Column) -> Column:
    return F.struct(time.alias("t"), side.alias("side"), tie.alias("tie"))


def hourly_sum(df: DataFrame, hour: Column, unit: str, value: str) -> DataFrame:
    """Sum per hour and unit; sums of exactly zero are left out."""
    total = F.sum(exact(df, value))
    return (
        df.groupBy(hour.alias("avg_datehour"), unit)
        .agg(total.alias("output"))
        .where(F.col("output") != 0)
        .withColumn("output", F.col("output").cast("double"))
    )


def exact(df: DataFrame, col: str) -> Column:
    """A value whose sums are exact: decimals as they are, others to 18 places.

    A sum that does not fit 20 digits before the point fails; none is rounded away.
    """
    kind = df.schema[col].dataType
    return F.col(col) if isinstance(kind, T.DecimalType) else F.col(col).cast("decimal(38,18)")
