"""Market series: segments, grids, hourly output, averages, ratios."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.catalog.registry import (
    COAL,
    HOURLY,
    MINUTES,
    POINTS,
    SEGMENTS,
    UNIQUE_POINTS,
    UNITS,
    coal,
    hourly,
    points,
    query,
    table,
    units,
    with_,
)
from gridmill.functions.ratios import banded_ratio, minute_energy, segment_energy, share_ratio
from gridmill.functions.times import day_window, hour_bucket
from gridmill.operators.intervals import (
    lead_segments,
    minute_grid,
    moment_slices,
    nonneg_levels,
    override_energy,
    point_slices,
)
from gridmill.operators.joins import (
    densify,
    eligible_output,
    not_yet_loaded,
    selected_units,
)
from gridmill.operators.latest import dedup, last_by
from gridmill.operators.slices import Slices
from gridmill.operators.tablesync import reload_day, zero_fill
from gridmill.operators.trailing import (
    row_slices,
    trailing_hours_avg,
    trailing_months_avg,
    trailing_rows_avg,
)
from gridmill.plans.market import daily_run, fuel_ratios, hourly_output, minute_output, unit_averages
from gridmill.session import cut_lineage

CARRY = ["acceptance_id", "acceptance_time", "ad", "np"]
COLS = ["acceptance_id", "ad", "np", "from_time", "from_level", "to_time", "to_level"]
AS_OF = datetime(2024, 1, 31)

# Fixed value: the unit that the daily figures leave out.
SKIPPED = ("T_BPGRD-1",)


def unique_points(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(points(spark, sf), ["bm_unit_id", "time_gmt"], "va_level", CARRY)


def segments(spark: SparkSession, sf: str) -> DataFrame:
    slices = point_slices(points(spark, sf), "time_gmt", "va_level", CARRY)
    return lead_segments(unique_points(spark, sf), ["bm_unit_id"], "time_gmt", "va_level", CARRY, slices)


def doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


@query(
    "lead_segments",
    """
    SELECT * FROM (
      SELECT user_id, ts AS from_time, value AS from_level, event_id,
             lead(ts) OVER w AS to_time, lead(value) OVER w AS to_level
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value, event_id))
    WHERE to_time IS NOT NULL""",
)
def _lead_segments(spark, sf):
    return lead_segments(table(spark, sf, "events"), ["user_id"], "ts", "value", ["event_id"])


@query(
    "dedup_row_number",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_extendedprice DESC NULLS FIRST) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def _dedup(spark, sf):
    return dedup(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query(
    "segment_energy",
    with_(POINTS, UNIQUE_POINTS, SEGMENTS)
    + """
    SELECT bm_unit_id, from_time, to_time,
      round((CAST(from_level AS DOUBLE) + CAST(to_level AS DOUBLE)) / 120
            * (epoch_us(to_time) - epoch_us(from_time)) / 60000000.0, 6) AS energy,
      round((CAST(from_level AS DOUBLE) + CAST(to_level AS DOUBLE)) / 120, 6) AS minute_energy
    FROM segments""",
)
def _segment_energy(spark, sf):
    s = segments(spark, sf)
    return s.select(
        "bm_unit_id",
        "from_time",
        "to_time",
        F.round(segment_energy("from_level", "to_level", "from_time", "to_time"), 6).alias("energy"),
        F.round(minute_energy("from_level", "to_level"), 6).alias("minute_energy"),
    )


@query(
    "nonneg_level_filter",
    with_(POINTS, UNIQUE_POINTS, SEGMENTS)
    + """
    SELECT bm_unit_id, from_time, to_time, CAST(from_level AS DOUBLE) AS from_level,
           CAST(to_level AS DOUBLE) AS to_level
    FROM segments WHERE from_level + to_level >= 0""",
)
def _nonneg(spark, sf):
    s = nonneg_levels(segments(spark, sf))
    return doubles(s.select("bm_unit_id", "from_time", "to_time", "from_level", "to_level"), "from_level", "to_level")


@query(
    "day_window_filter",
    """
    SELECT event_id, ts, user_id, value FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-09' AND DATE '2024-01-11'""",
)
def _day_window(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return day_window(e, "ts", date(2024, 1, 10), before=1, after=1)


@query("hour_bucket", "SELECT event_id, date_trunc('hour', ts) AS avg_hour FROM events")
def _hour_bucket(spark, sf):
    return table(spark, sf, "events").select("event_id", hour_bucket("ts").alias("avg_hour"))


@query(
    "point_in_interval_grid",
    with_(POINTS, UNIQUE_POINTS, SEGMENTS, MINUTES)
    + " SELECT bm_unit_id, acceptance_id, from_time, to_time, avg_time FROM minutes",
)
def _grid(spark, sf):
    g = minute_grid(nonneg_levels(segments(spark, sf)))
    return g.select("bm_unit_id", "acceptance_id", "from_time", "to_time", "avg_time")


LATEST_MINUTES = """
latest AS (
  SELECT m.bm_unit_id, m.avg_time, m.acceptance_time, max(acceptance_id) AS acceptance_id,
         max(ad) AS ad, max(np) AS np, max(from_time) AS from_time,
         max(from_level) AS from_level, max(to_time) AS to_time, max(to_level) AS to_level
  FROM minutes m JOIN (
    SELECT bm_unit_id, avg_time, max(acceptance_time) AS t FROM minutes GROUP BY 1, 2) x
    ON m.bm_unit_id = x.bm_unit_id AND m.avg_time = x.avg_time AND m.acceptance_time = x.t
  GROUP BY 1, 2, 3)"""


@query(
    "keep_dense_rank_last",
    with_(POINTS, UNIQUE_POINTS, SEGMENTS, MINUTES, LATEST_MINUTES)
    + """
    SELECT bm_unit_id, avg_time, acceptance_time, acceptance_id, ad, np, from_time,
           CAST(from_level AS DOUBLE) AS from_level, to_time,
           CAST(to_level AS DOUBLE) AS to_level
    FROM latest""",
)
def _keep_last(spark, sf):
    g = minute_grid(nonneg_levels(segments(spark, sf)))
    return doubles(
        last_by(g, ["bm_unit_id", "avg_time"], "acceptance_time", COLS), "from_level", "to_level"
    )


@query(
    "minute_output",
    with_(POINTS, UNIQUE_POINTS, SEGMENTS, MINUTES, LATEST_MINUTES)
    + """
    SELECT bm_unit_id, avg_time, acceptance_time, acceptance_id,
           round((CAST(from_level AS DOUBLE) + CAST(to_level AS DOUBLE)) / 120, 6) AS avg_level
    FROM latest""",
)
def minute_output_query(spark, sf):
    out = minute_output(points(spark, sf), keys=["bm_unit_id"], carry=CARRY)
    return rounded(
        out.select("bm_unit_id", "avg_time", "acceptance_time", "acceptance_id", "avg_level"),
        "avg_level",
    )


def moments(spark: SparkSession, sf: str) -> Slices:
    return moment_slices(table(spark, sf, "events"), "ts")


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Segments between the `view` events of a user."""
    views = table(spark, sf, "events").where(F.col("event_type") == "view").select(
        F.col("user_id").alias("bm_unit_id"),
        "ts",
        F.col("value").cast("decimal(18,4)").alias("level"),
    )
    return lead_segments(views, ["bm_unit_id"], "ts", "level")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """The `click` events of a user."""
    return table(spark, sf, "events").where(F.col("event_type") == "click").select(
        F.col("user_id").alias("bm_unit_id"),
        F.col("ts").alias("avg_time"),
        F.col("value").cast("decimal(18,4)").alias("avg_level"),
    )


SCHEDULE = """
schedule AS (
  SELECT *, (CAST(from_level AS DOUBLE) + CAST(to_level AS DOUBLE)) / 120
            * ((epoch_us(to_time) - epoch_us(from_time)) / 60000000.0) AS energy
  FROM (SELECT user_id AS bm_unit_id, ts AS from_time, CAST(value AS DECIMAL(18,4)) AS from_level,
               lead(ts) OVER w AS to_time, CAST(lead(value) OVER w AS DECIMAL(18,4)) AS to_level
        FROM events WHERE event_type = 'view'
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
  WHERE to_time IS NOT NULL),
readings AS (
  SELECT user_id AS bm_unit_id, ts AS avg_time, CAST(value AS DECIMAL(18,4)) AS avg_level
  FROM events WHERE event_type = 'click'),
override AS (
  SELECT a.bm_unit_id, a.from_time, a.to_time, a.energy,
         CAST(sum(b.avg_level) AS DOUBLE) AS matched,
         coalesce(CAST(sum(b.avg_level) AS DOUBLE), a.energy) AS output
  FROM schedule a LEFT JOIN readings b
    ON a.bm_unit_id = b.bm_unit_id AND b.avg_time BETWEEN a.from_time AND a.to_time
  WHERE a.from_level + a.to_level >= 0
  GROUP BY 1, 2, 3, 4),
hour_out AS (
  SELECT date_trunc('hour', from_time) AS avg_datehour, bm_unit_id,
         CAST(sum(CAST(output AS DECIMAL(28,10))) AS DOUBLE) AS output
  FROM override GROUP BY 1, 2 HAVING sum(CAST(output AS DECIMAL(28,10))) <> 0)"""


@query(
    "range_left_join_sum",
    with_(SCHEDULE)
    + """
    SELECT bm_unit_id, from_time, to_time, round(energy, 6) AS energy,
           round(matched, 6) AS matched, round(output, 6) AS output FROM override""",
)
def _override(spark, sf):
    energy = segment_energy("from_level", "to_level", "from_time", "to_time")
    planned = nonneg_levels(schedule(spark, sf)).withColumn("energy", energy)
    out = override_energy(
        planned, readings(spark, sf), "bm_unit_id", "from_time", "to_time", "energy",
        "avg_time", "avg_level", slices=moments(spark, sf),
    )
    return rounded(out, "energy", "matched", "output")


@query(
    "hourly_sum_having",
    with_(SCHEDULE) + " SELECT avg_datehour, bm_unit_id, round(output, 6) AS output FROM hour_out",
)
def _hourly_sum(spark, sf):
    out = hourly_output(schedule(spark, sf), readings(spark, sf), group=[], slices=moments(spark, sf))
    return rounded(out, "output")


@query(
    "theta_inner_join",
    with_(HOURLY, UNITS)
    + """
    SELECT h.bm_unit_id, h.avg_datehour, CAST(h.output AS DOUBLE) AS output, u.station_name
    FROM hourly h JOIN units u ON h.bm_unit_id = u.bm_unit_id AND h.avg_datehour >= u.online_date""",
)
def _theta(spark, sf):
    out = eligible_output(hourly(spark, sf), units(spark, sf), "bm_unit_id", "avg_datehour", "online_date")
    return doubles(out.select("bm_unit_id", "avg_datehour", "output", "station_name"), "output")


def loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of purchases stand for what is loaded already."""
    return (
        table(spark, sf, "events")
        .where(F.col("event_type") == "purchase")
        .select(F.col("user_id").alias("bm_unit_id"), hour_bucket("ts").alias("avg_datehour"))
        .distinct()
    )


LOADED = """
loaded AS (
  SELECT DISTINCT user_id AS bm_unit_id, date_trunc('hour', ts) AS avg_datehour
  FROM events WHERE event_type = 'purchase')"""


@query(
    "anti_not_exists",
    with_(HOURLY, LOADED)
    + """
    SELECT bm_unit_id, avg_datehour, CAST(output AS DOUBLE) AS output FROM hourly h
    WHERE NOT EXISTS (SELECT 1 FROM loaded l WHERE l.bm_unit_id = h.bm_unit_id
                      AND l.avg_datehour = h.avg_datehour)""",
)
def _not_exists(spark, sf):
    out = not_yet_loaded(hourly(spark, sf), loaded(spark, sf), ["bm_unit_id", "avg_datehour"])
    return doubles(out.select("bm_unit_id", "avg_datehour", "output"), "output")


@query(
    "anti_left_is_null",
    with_(SCHEDULE, LOADED)
    + """
    SELECT a.avg_datehour, a.bm_unit_id, round(a.output, 6) AS output
    FROM hour_out a LEFT JOIN loaded b
      ON a.bm_unit_id = b.bm_unit_id AND a.avg_datehour = b.avg_datehour
    WHERE b.bm_unit_id IS NULL""",
)
def _left_is_null(spark, sf):
    out = hourly_output(
        schedule(spark, sf), readings(spark, sf), loaded(spark, sf), group=[], slices=moments(spark, sf)
    )
    return rounded(out.select("avg_datehour", "bm_unit_id", "output"), "output")


TRAILING = """
hour_avgs AS (
  SELECT bm_unit_id, avg_datehour, output,
    CAST(sum(output) OVER (w RANGE BETWEEN INTERVAL '02:59:59.999999' PRECEDING AND CURRENT ROW) AS DOUBLE) / 3 AS avg3hour,
    CAST(sum(output) OVER (w RANGE BETWEEN INTERVAL '11:59:59.999999' PRECEDING AND CURRENT ROW) AS DOUBLE) / 12 AS avg12hour,
    CAST(sum(output) OVER (w RANGE BETWEEN INTERVAL '71:59:59.999999' PRECEDING AND CURRENT ROW) AS DOUBLE) / 72 AS avg72hour
  FROM hourly WINDOW w AS (PARTITION BY bm_unit_id ORDER BY avg_datehour))"""


@query(
    "trailing_hours_avg",
    with_(HOURLY, TRAILING)
    + """
    SELECT bm_unit_id, avg_datehour, CAST(output AS DOUBLE) AS output, avg3hour, avg12hour, avg72hour
    FROM hour_avgs""",
)
def _trailing_hours(spark, sf):
    out = trailing_hours_avg(hourly(spark, sf), "bm_unit_id", "avg_datehour", "output")
    return doubles(out, "output")


@query(
    "trailing_rows_avg",
    with_(HOURLY)
    + """
    SELECT bm_unit_id, avg_datehour,
      CAST(sum(output) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
        / count(output) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg3rows,
      CAST(sum(output) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS DOUBLE)
        / count(output) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS avg12rows,
      CAST(sum(output) OVER (w ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS DOUBLE)
        / count(output) OVER (w ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS avg72rows
    FROM hourly WINDOW w AS (PARTITION BY bm_unit_id ORDER BY avg_datehour)""",
)
def _trailing_rows(spark, sf):
    hours = table(spark, sf, "events").select(hour_bucket("ts").alias("avg_datehour"))
    slices = row_slices(hours, "avg_datehour")
    out = trailing_rows_avg(hourly(spark, sf), ["bm_unit_id"], "avg_datehour", "output", slices=slices)
    return out.drop("output")


@query(
    "group_avg",
    with_(HOURLY, UNITS, LOADED, TRAILING)
    + """
    SELECT h.bm_unit_id, h.avg_datehour, u.station_name, u.parent_name,
           round(avg(CAST(h.output AS DOUBLE)), 6) AS output, round(avg(t.avg3hour), 6) AS avg3hour,
           round(avg(t.avg12hour), 6) AS avg12hour, round(avg(t.avg72hour), 6) AS avg72hour,
           round(avg(u.ef_co2), 6) AS ef_co2
    FROM hourly h JOIN units u ON h.bm_unit_id = u.bm_unit_id AND h.avg_datehour >= u.online_date
    JOIN hour_avgs t ON t.bm_unit_id = h.bm_unit_id AND t.avg_datehour = h.avg_datehour
    WHERE NOT EXISTS (SELECT 1 FROM loaded l WHERE l.bm_unit_id = h.bm_unit_id
                      AND l.avg_datehour = h.avg_datehour)
    GROUP BY 1, 2, 3, 4""",
)
def _group_avg(spark, sf):
    out = unit_averages(
        hourly(spark, sf), units(spark, sf), loaded(spark, sf), "bm_unit_id",
        ["station_name", "parent_name"], ["ef_co2"],
    )
    return rounded(out, "output", "avg3hour", "avg12hour", "avg72hour", "ef_co2")


@query(
    "cross_densify",
    with_(HOURLY, UNITS)
    + """
    SELECT a.bm_unit_id, b.avg_datehour, CAST(0 AS DOUBLE) AS output
    FROM (SELECT DISTINCT bm_unit_id FROM units WHERE include = 1) a,
         (SELECT (SELECT max(avg_datehour) FROM hourly) - INTERVAL 72 HOURS + to_hours(CAST(x AS INTEGER)) AS avg_datehour
          FROM range(73) r(x)) b
    WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.bm_unit_id = a.bm_unit_id
      AND h.avg_datehour = b.avg_datehour AND h.avg_datehour >= TIMESTAMP '2024-01-28')""",
)
def _densify(spark, sf):
    chosen = selected_units(units(spark, sf), "bm_unit_id", SKIPPED)
    out = densify(hourly(spark, sf), chosen, "bm_unit_id", "avg_datehour", "output", AS_OF)
    return doubles(out, "output")


@query(
    "distinct_keys",
    with_(UNITS) + " SELECT DISTINCT bm_unit_id FROM units WHERE include = 1",
)
def _distinct(spark, sf):
    return selected_units(units(spark, sf), "bm_unit_id", SKIPPED)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly output rolled to days, with the day's year and week."""
    day = F.date_trunc("day", "avg_datehour").cast("timestamp_ntz")
    return (
        hourly(spark, sf)
        .groupBy("bm_unit_id", day.alias("avg_date"))
        .agg(F.sum("output").cast("double").alias("co2"))
        .withColumn("year", F.year("avg_date").cast("bigint"))
        .withColumn("week", F.weekofyear("avg_date").cast("bigint"))
    )


DAILY = """
daily AS (
  SELECT bm_unit_id, date_trunc('day', avg_datehour)::TIMESTAMP AS avg_date,
         CAST(sum(output) AS DOUBLE) AS co2,
         CAST(year(date_trunc('day', avg_datehour)) AS BIGINT) AS year,
         CAST(weekofyear(date_trunc('day', avg_datehour)) AS BIGINT) AS week
  FROM hourly GROUP BY 1, 2, 4, 5)"""


@query(
    "zero_fill_latest",
    with_(HOURLY, UNITS, DAILY)
    + """
    SELECT u.bm_unit_id, u.parent_name, u.station_name, n.avg_date, n.year, n.week,
           CAST(0 AS DOUBLE) AS co2
    FROM units u, (SELECT DISTINCT avg_date, year, week FROM daily
                   WHERE avg_date = (SELECT max(avg_date) FROM daily)) n
    WHERE u.include = 1 AND NOT EXISTS (
      SELECT 1 FROM daily d WHERE d.avg_date = n.avg_date AND d.bm_unit_id = u.bm_unit_id)""",
)
def _zero_fill(spark, sf):
    return zero_fill(
        daily(spark, sf), units(spark, sf), "bm_unit_id", "avg_date", "co2", ["year", "week"],
        ["parent_name", "station_name"], SKIPPED,
    )


@query(
    "replace_day_append",
    with_(HOURLY, DAILY)
    + """
    SELECT bm_unit_id, avg_date, co2, year, week FROM daily WHERE avg_date < TIMESTAMP '2024-01-28'
    UNION ALL
    SELECT bm_unit_id, avg_date, 2 * co2 AS co2, year, week FROM daily
    WHERE avg_date >= TIMESTAMP '2024-01-28'""",
)
def _replace_day(spark, sf):
    """The target ends on the 28th; that day and the later ones come anew, doubled."""
    d = daily(spark, sf)
    old = d.where(F.col("avg_date") < F.lit("2024-01-29").cast("timestamp_ntz"))
    return reload_day(d.withColumn("co2", F.col("co2") * 2), old, "avg_date", date(2024, 1, 28))


def figures_of(averages: DataFrame) -> DataFrame:
    """Output times the unit's factor, for every hour."""
    co2 = F.round(F.col("output") * F.col("ef_co2"), 4).cast("decimal(28,4)")
    return averages.select("bm_unit_id", "parent_name", "station_name", "avg_datehour", co2.alias("co2"))


def days_of(figures: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "avg_datehour").cast("timestamp_ntz")
    days = figures.groupBy("bm_unit_id", "parent_name", "station_name", day.alias("avg_date")).agg(F.sum("co2").alias("co2"))
    return days.withColumns({"year": F.year("avg_date").cast("bigint"), "week": F.weekofyear("avg_date").cast("bigint")})


# The tables as a run at noon of the 30th has left them: hours before noon, and that day's
# figures up to there. The next run is on the 31st.
RUN = """
zeros AS (
  SELECT a.bm_unit_id, b.avg_datehour, CAST(0 AS DECIMAL(38,4)) AS output
  FROM (SELECT DISTINCT bm_unit_id FROM units WHERE include = 1) a,
       (SELECT (SELECT max(avg_datehour) FROM hourly) - INTERVAL 72 HOURS + to_hours(CAST(x AS INTEGER)) AS avg_datehour
        FROM range(73) r(x)) b
  WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.bm_unit_id = a.bm_unit_id
    AND h.avg_datehour = b.avg_datehour AND h.avg_datehour >= TIMESTAMP '2024-01-28')),
before AS (
  SELECT h.bm_unit_id, h.avg_datehour, u.station_name, u.parent_name, CAST(output AS DOUBLE) AS output, u.ef_co2
  FROM hourly h JOIN units u ON h.bm_unit_id = u.bm_unit_id AND h.avg_datehour >= u.online_date
  WHERE h.avg_datehour < TIMESTAMP '2024-01-30 12:00:00'),
fresh AS (
  SELECT h.bm_unit_id, h.avg_datehour, u.station_name, u.parent_name, h.output, u.ef_co2
  FROM (SELECT bm_unit_id, avg_datehour, avg(CAST(output AS DOUBLE)) AS output
        FROM (SELECT * FROM hourly UNION ALL SELECT * FROM zeros) GROUP BY 1, 2) h
  JOIN units u ON h.bm_unit_id = u.bm_unit_id AND h.avg_datehour >= u.online_date
  WHERE h.avg_datehour > TIMESTAMP '2024-01-26'
    AND NOT EXISTS (SELECT 1 FROM before b WHERE b.bm_unit_id = h.bm_unit_id AND b.avg_datehour = h.avg_datehour)),
figures AS (
  SELECT bm_unit_id, parent_name, station_name, avg_datehour, CAST(round(output * ef_co2, 4) AS DECIMAL(28,4)) AS co2
  FROM (SELECT * FROM before
        UNION ALL SELECT * FROM fresh WHERE avg_datehour > (SELECT max(avg_datehour) FROM before))),
days AS (
  SELECT bm_unit_id, parent_name, station_name, date_trunc('day', avg_datehour)::TIMESTAMP AS avg_date, sum(co2) AS co2
  FROM figures GROUP BY 1, 2, 3, 4),
filled AS (
  SELECT * FROM days UNION ALL
  SELECT u.bm_unit_id, u.parent_name, u.station_name, n.avg_date, 0
  FROM units u, (SELECT max(avg_date) AS avg_date FROM days) n
  WHERE u.include = 1 AND NOT EXISTS (
    SELECT 1 FROM days d WHERE d.avg_date = n.avg_date AND d.bm_unit_id = u.bm_unit_id))"""


@query(
    "daily_run",
    with_(HOURLY, UNITS, RUN)
    + """
    SELECT bm_unit_id, parent_name, station_name, avg_date, CAST(co2 AS DOUBLE) AS co2,
           CAST(year(avg_date) AS BIGINT) AS year, CAST(weekofyear(avg_date) AS BIGINT) AS week
    FROM filled""",
)
def _daily_run(spark, sf):
    """Daily figures after the run of the 31st."""
    noon = F.col("avg_datehour") < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    hours, known, cols = hourly(spark, sf), units(spark, sf), ["station_name", "parent_name"]
    averages = cut_lineage(unit_averages(hours, known, None, "bm_unit_id", cols, ["ef_co2"]).where(noon))
    figures = cut_lineage(figures_of(averages))
    run = daily_run(
        hours, known, averages, figures, days_of(figures), AS_OF, figures_of, days_of,
        "bm_unit_id", cols, ["ef_co2"], ["year", "week"], "co2", cols, SKIPPED,
    )
    return doubles(run.daily, "co2")


@query(
    "banded_ratio",
    with_(COAL) + " SELECT entity_id, period, coal_ratio FROM rated",
)
def _banded(spark, sf):
    ratio = banded_ratio("coal_burns", "mwh_coal")
    return coal(spark, sf).select("entity_id", "period", ratio.alias("coal_ratio"))


@query(
    "share_ratio",
    with_(COAL) + " SELECT entity_id, period, coal_factor FROM rated",
)
def _share(spark, sf):
    ratio = share_ratio("mwh_coal", "mwh_other")
    return coal(spark, sf).select("entity_id", "period", ratio.alias("coal_factor"))


SIX_MONTHS = """
SELECT entity_id, period, {cols}
  round(avg(coal_ratio) OVER w, 9) AS coal_ratio_6mth_avg,
  round(avg(coal_factor) OVER w, 9) AS coal_factor_6mth_avg
FROM rated
WINDOW w AS (PARTITION BY entity_id
             ORDER BY CAST(substr(period, 1, 4) AS INTEGER) * 12 + CAST(substr(period, 6, 2) AS INTEGER)
             RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)"""


@query("trailing_months_avg", with_(COAL) + SIX_MONTHS.format(cols=""))
def _trailing_months(spark, sf):
    rated = coal(spark, sf).select(
        "entity_id",
        "period",
        banded_ratio("coal_burns", "mwh_coal").alias("r"),
        share_ratio("mwh_coal", "mwh_other").alias("f"),
    )
    out = trailing_months_avg(rated, "entity_id", "period", ["r", "f"])
    return out.select(
        "entity_id",
        "period",
        F.round("r_avg", 9).alias("coal_ratio_6mth_avg"),
        F.round("f_avg", 9).alias("coal_factor_6mth_avg"),
    )


@query(
    "fuel_ratios",
    with_(COAL)
    + SIX_MONTHS.format(
        cols="mwh_coal, mwh_other, coal_burns, coal_ratio, coal_factor,"
    ),
)
def _fuel_ratios(spark, sf):
    averages = ["coal_ratio_6mth_avg", "coal_factor_6mth_avg"]
    return fuel_ratios(coal(spark, sf)).withColumns({c: F.round(c, 9) for c in averages})


@query(
    "six_row_avg",
    with_(COAL)
    + """
    SELECT entity_id, period, round(avg(mwh_coal) OVER (
      PARTITION BY entity_id ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS avg6rows
    FROM rated""",
)
def _six_rows(spark, sf):
    months = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("period"))
    slices = row_slices(months, "period")
    out = trailing_rows_avg(coal(spark, sf), ["entity_id"], "period", "mwh_coal", [6], slices)
    return rounded(out.select("entity_id", "period", "avg6rows"), "avg6rows")
