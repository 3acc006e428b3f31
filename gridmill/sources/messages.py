"""Acceptance messages of the balancing market.

    2024:01:10:09:30:00:GMT: subject=X.BM.UNIT-1.BOALF, message={NK=77,SO=F,
    TA=2024:01:10:09:29:00:GMT,AD=F,NP=2,TS=2024:01:10:09:30:00:GMT,VA=10.0,TS=...,VA=...}

(one line each). NP is the number of (TS, VA) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Message type and the shape of its parts.
MESSAGE_TYPE = "BOALF"
PREFIX = r"^[^.]*\.BM\."
BODY_START = r"\.BOALF, message=\{"
TAG = r"[A-Z][A-Z]="
TIME = r"(\d{4}):(\d{2}):(\d{2}):(\d{2}):"


def parse_acceptance_messages(lines: DataFrame, col: str = "value") -> DataFrame:
    """One row per point of every acceptance message in the lines.

    A value that cannot be read is NULL; a line without a point count is left out. The
    count is a claim: a line gives no more points than it has fields for, the last of
    which may lack its value (see unfit_messages).
    """
    points = _points(lines, col)
    # f[6], f[7] hold the first pair. The count is tested in the generator: a filter on it
    # would move below and parse every line twice.
    present = F.ceil((F.size("f") - 6) / 2).cast("int")
    n = F.when(F.col("np") > 0, F.least("np", present))
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    pairs = points.withColumn("i", F.explode(numbers))
    return pairs.select(
        F.col("f")[0].alias("bm_unit_id"),
        F.get("f", F.lit(1)).alias("acceptance_id"),
        F.get("f", F.lit(2)).alias("so"),
        _time(F.get("f", F.lit(3))).alias("acceptance_time"),
        F.get("f", F.lit(4)).alias("ad"),
        F.col("np").cast("decimal(10,0)").alias("np"),
        _time(F.get("f", F.col("i") * 2 + 6)).alias("time_gmt"),
        F.get("f", F.col("i") * 2 + 7).try_cast("decimal(18,4)").alias("va_level"),
    )


def unfit_messages(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of acceptance messages whose point count is missing or not that of their points."""
    points = _points(lines, col)
    fits = F.col("np") * 2 + 6 == F.size("f")
    return points.where(~F.coalesce(fits, F.lit(False))).select("line")


def _points(lines: DataFrame, col: str) -> DataFrame:
    """(line, f, np): fields and point count of each message."""
    text = F.regexp_replace(F.col(col), PREFIX, "")
    text = F.regexp_replace(text, BODY_START, ",")
    for pattern in (TAG, r"\}$", ":GMT"):
        text = F.regexp_replace(text, pattern, "")
    fields = lines.where(F.col(col).contains(MESSAGE_TYPE)).select(F.col(col).alias("line"), F.split(text, ",").alias("f"))
    return fields.withColumn("np", F.get("f", F.lit(5)).try_cast("int"))


def _time(text: Column) -> Column:
    iso = F.regexp_replace(text, TIME, "$1-$2-$3 $4:")
    return iso.try_cast("timestamp_ntz")
