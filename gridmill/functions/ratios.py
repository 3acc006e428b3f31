"""Ratio and energy expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmill.functions.times import minutes_between

# The band in which a burn ratio counts, and the divisor that turns a
# sum of two levels over a minute into energy (mean of two, 60 minutes to the hour).
BAND_LOW = 0.3
BAND_HIGH = 0.9
LEVEL_DIVISOR = 120


def banded_ratio(
    num: Column | str, den: Column | str, lo: float = BAND_LOW, hi: float = BAND_HIGH
) -> Column:
    """num/den where it lies in [lo, hi]; NULL outside the band and for den = 0."""
    n, d = _col(num), _col(den)
    ratio = F.when(d != 0, n / d)
    return F.when(ratio.between(lo, hi), ratio)


def share_ratio(a: Column | str, b: Column | str) -> Column:
    """a / (a + b), b read as 0 when NULL; NULL where the sum is 0."""
    x = _col(a)
    total = x + F.coalesce(_col(b), F.lit(0).cast("double"))
    return F.when(total != 0, x / total)


def minute_energy(from_level: Column | str, to_level: Column | str) -> Column:
    """Energy of one minute at the mean of the two levels."""
    return (_col(from_level).cast("double") + _col(to_level).cast("double")) / LEVEL_DIVISOR


def segment_energy(
    from_level: Column | str, to_level: Column | str, start: Column | str, end: Column | str
) -> Column:
    """Mean level times duration."""
    return minute_energy(from_level, to_level) * minutes_between(start, end)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
