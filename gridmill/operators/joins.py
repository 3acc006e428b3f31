"""Joins. Broadcasts are left to Spark, which checks the size of the side first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: hours back from the newest hour that are filled with zeros.
FILL_HOURS = 72


def eligible_output(
    hourly: DataFrame, units: DataFrame, unit: str, hour: str, online: str
) -> DataFrame:
    """Hourly rows of known units from the unit's online date on."""
    return hourly.join(units, unit).where(F.col(hour) >= F.col(online))


@dataclass(frozen=True)
class Within:
    """Lowest and highest value of a key column in the incoming rows, as one-row subqueries."""

    col: str
    low: Column
    high: Column


def within(rows: DataFrame, value: Column | str, col: str) -> Within:
    """The range of value over rows, for the key column col; two passes over one column.

    Two minima, or two maxima, Spark would compute in one and then take apart, and a part
    of a result does not reach a scan; so the low end is the first row in order.
    """
    at = (F.col(value) if isinstance(value, str) else value).alias("_at")
    first = rows.select(at).where(F.col("_at").isNotNull()).orderBy("_at").limit(1)
    return Within(col, first.scalar(), rows.agg(F.max(at)).scalar())


def not_yet_loaded(
    df: DataFrame, target: DataFrame, keys: Sequence[str], near: Within | None = None
) -> DataFrame:
    """Rows with no partner in target; a NULL key never has one.

    near: a range that holds the rows' values of one key column. Only that part of the
    target is read: the range is a subquery whose result prunes the scan, by partition or
    by file statistics, so a long history costs what its recent part does. A row outside
    the range has no partner in it and would be kept, so near must cover all of df.
    """
    if near is not None:
        target = target.where(F.col(near.col).between(near.low, near.high))
    return df.join(target.select(*keys), list(keys), "left_anti")


def semi(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are among the wanted ones."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: str, id_col: str | None = None) -> DataFrame:
    """NOT IN with its NULL rules: one NULL id removes every row, no id removes none."""
    listed = ids.select(F.col(id_col or key).alias(key))
    counts = listed.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known"))
    n, known = counts.select("n").scalar(), counts.select("known").scalar()
    rest = df.join(listed.where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rest.where((n == 0) | ((n == known) & F.col(key).isNotNull())).select(*df.columns)


def latest_backup_pieces(
    jobs: DataFrame,
    sets: DataFrame,
    pieces: DataFrame,
    sites: DataFrame,
    db_unique_name: str | None = None,
    input_type: str = "DB INCR",
    once: bool = False,
) -> DataFrame:
    """Pieces of the newest completed full backup of each database (or of one).

    Columns: db_key, piece (name after the last slash), completion_time; ordered by
    completion. With `once`, pieces of equal name and time are listed once.
    """
    dbs = sites if db_unique_name is None else sites.where(F.col("db_unique_name") == db_unique_name)
    own_jobs = jobs.join(dbs.select("db_key").distinct(), "db_key", "left_semi")
    full = sets.where(
        ((F.col("incremental_level") == 0) & (F.col("backup_type") == "I"))
        | (F.col("backup_type") == "D")
    ).select("db_key", "session_key").distinct()
    completed = own_jobs.where(
        F.col("end_time").isNotNull()
        & F.col("status").like("COMPLETED%")
        & (F.col("input_type") == input_type)
    ).join(full, ["db_key", "session_key"], "left_semi")
    newest = completed.groupBy("db_key").agg(F.max("end_time").alias("end_time"))
    sessions = (
        own_jobs.join(newest, ["db_key", "end_time"], "left_semi")
        .select("db_key", "session_key")
        .distinct()
    )
    backup_sets = sets.select("bs_key", "session_key").distinct().join(sessions, "session_key")
    found = pieces.join(backup_sets.select("bs_key", "db_key").distinct(), "bs_key").select(
        "db_key",
        F.substring_index("handle", "/", -1).alias("piece"),
        "completion_time",
    )
    return (found.distinct() if once else found).orderBy("completion_time", "piece")


def densify(
    hourly: DataFrame,
    units: DataFrame,
    unit: str,
    hour: str,
    value: str,
    as_of: datetime,
    hours: int = FILL_HOURS,
) -> DataFrame:
    """Zero rows for each unit and hour of the last `hours` hours that has none.

    Only rows since midnight of as_of, three days back, are looked at, so an older
    hour gets a second, zero row.
    """
    newest = hourly.agg(F.max(hour)).scalar()
    step = F.expr("INTERVAL 1 HOUR")
    first = newest - F.expr(f"INTERVAL {int(hours)} HOURS")
    grid = units.select(unit).distinct().withColumn(hour, F.explode(F.sequence(first, newest, step)))
    seen_from = datetime(as_of.year, as_of.month, as_of.day) - timedelta(days=3)
    seen = hourly.where(F.col(hour) >= F.lit(seen_from).cast("timestamp_ntz"))
    missing = not_yet_loaded(grid, seen, [unit, hour])
    return missing.withColumn(value, F.lit(0).cast(hourly.schema[value].dataType))


def selected_units(
    units: DataFrame, unit: str, skip: Sequence[str], include: str = "include"
) -> DataFrame:
    """Distinct units marked for inclusion, but for those in skip."""
    kept = units.where(F.col(include).cast("int") == 1)
    if skip:
        kept = kept.where(~F.col(unit).cast("string").isin(list(skip)))
    return kept.select(unit).distinct()


def find_instances(
    df: DataFrame, text: str, redshift_db: str, other_db: str
) -> DataFrame:
    """Connection lines of current instances whose name contains the text."""
    head = F.format_string("psql -h %s -p %s -d ", "endpoint", F.col("port").cast("string"))
    tail = F.concat(F.lit(" -U "), F.col("master_user"))
    whole = F.concat(F.lit("Instance_Name: "), F.col("instance_name"), F.lit(" "), head, tail)
    db = F.when(_holds(whole, "redshift"), redshift_db).otherwise(other_db)
    return df.where(F.col("instance_name").contains(text) & (F.col("dba_state") == "current")).select(
        "instance_name", F.concat(head, db, tail).alias("connect")
    )


def _holds(text: Column, word: str) -> Column:
    return F.lower(text).contains(word)
