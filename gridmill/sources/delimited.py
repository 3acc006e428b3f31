"""Delimited text: tolerant load, export, and one-line-per-row output."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.rows import pg_order
from gridmill.functions.times import text_ntz
from gridmill.session import work_path

# Fixed value: bad rows a load tolerates before it fails.
MAX_ERRORS = 9999
_BAD = "_bad_line"


class TooManyBadRows(ValueError):
    pass


@dataclass(frozen=True)
class Load:
    rows: DataFrame
    bad: DataFrame
    n_read: int
    n_bad: int


# Escapes of the text form of a database's COPY, and its NULL.
NULL = r"\N"
_BARE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_ESCAPES = {"\n": r"\n", "\r": r"\r", "\t": r"\t"}
# Stands for escaped characters while a line is split; doubled by a letter where it is text.
_HELD = "\u0001"


def _escaped(value: Column, sep: str) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit(r"\\"))
    for raw, text in {**_ESCAPES, sep: f"\\{sep}"}.items():
        out = F.replace(out, F.lit(raw), F.lit(text))
    return out


def split_line(line: Column, sep: str, null: str = NULL) -> Column:
    """Fields of an escaped line, as an array of text with NULLs."""
    marks = {_HELD: "a", r"\\": "b", f"\\{sep}": "c", r"\n": "d", r"\r": "e", r"\t": "f"}
    if null == NULL:
        marks[NULL] = "g"
    raw = dict(zip("abcdef", [_HELD, "\\", sep, "\n", "\r", "\t"]))
    held = line
    for text, letter in marks.items():
        held = F.replace(held, F.lit(text), F.lit(_HELD + letter))

    def plain(field: Column) -> Column:
        out = field
        for letter in "bcdefa":
            out = F.replace(out, F.lit(_HELD + letter), F.lit(raw[letter]))
        return F.when(field != F.lit(_HELD + "g" if null == NULL else null), out)

    return F.transform(F.split(held, F.lit(re.escape(sep))), plain)


def load_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_errors: int = MAX_ERRORS,
    sep: str = ",",
    null: str = NULL,
) -> Load:
    """Rows that fit the schema, the lines that do not, and the load counts.

    Lines are in the form of export_delimited; empty lines are skipped. Each is parsed
    once: rows and counts are written to the shared folder in one pass.
    """
    fields = spark.read.text(path).where(F.length("value") > 0).select("value", split_line(F.col("value"), sep, null).alias("f"))
    cast = [F.get("f", F.lit(i)).try_cast(s.dataType).alias(s.name) for i, s in enumerate(schema.fields)]
    lost = [F.get("f", F.lit(i)).isNotNull() & F.col(f"r.{s.name}").isNull() for i, s in enumerate(schema.fields)]
    bad = (F.size("f") != len(schema)) | reduce(Column.__or__, lost)
    parsed = fields.select("value", "f", F.struct(*cast).alias("r")).select("r.*", F.when(bad, F.col("value")).alias(_BAD))
    seen = Observation()
    held = work_path(spark, "load")
    parsed.observe(seen, F.count(F.lit(1)).alias("n"), F.count(_BAD).alias("bad")).write.parquet(held)
    n_read, n_bad = seen.get["n"], seen.get["bad"]
    if n_bad > max_errors:
        raise TooManyBadRows(f"{n_bad} bad rows in {path}, at most {max_errors} allowed")
    kept = spark.read.schema(parsed.schema).parquet(held)
    return Load(
        kept.where(F.col(_BAD).isNull()).drop(_BAD),
        kept.where(F.col(_BAD).isNotNull()).select(F.col(_BAD).alias("line")),
        n_read,
        n_bad,
    )


def line_of(df: DataFrame, sep: str = "|", null: str = NULL) -> Column:
    """A row of df as one line: values as they are, with the separator, the backslash and line
    breaks escaped, and NULL apart from the empty string. Different rows have different lines."""
    if len(sep) != 1 or sep in "\\\n\rntNr":
        raise ValueError("the separator is one character that no escape uses")

    def text(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`").cast("string")
        # Numbers and times are written in digits, letters and a few marks: nothing to escape.
        bare = isinstance(field.dataType, _BARE) and not sep.isalnum() and sep not in "+-.: "
        return F.coalesce(value if bare else _escaped(value, sep), F.lit(null))

    return F.concat_ws(sep, *[text(f) for f in df.schema.fields])


def export_delimited(
    df: DataFrame, path: str, sep: str = "|", null: str = NULL, compression: str | None = None
) -> None:
    """Write the line_of each row."""
    writer = df.select(line_of(df, sep, null).alias("value")).write
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the lines of to_lines, in order over the files; a NULL line is left out."""
    lines.where(F.col("line").isNotNull()).write.text(path)


def to_lines(
    df: DataFrame, cols: Sequence[str], order: Sequence[str] = (), sep: str = ","
) -> DataFrame:
    """One column `line`: the columns joined, NULL if any is NULL, fully ordered.

    Times are printed to the minute.
    """
    types = dict(df.dtypes)

    def text(name: str) -> Column:
        if types[name].startswith("timestamp"):
            return F.left(text_ntz(name), F.lit(16))
        return F.col(name).cast("string")

    parts: list[Column] = []
    for name in cols:
        parts += [text(name), F.lit(sep)]
    rows = df.orderBy(*pg_order(*order)) if order else df
    return rows.select(F.concat(*parts[:-1]).alias("line"))
