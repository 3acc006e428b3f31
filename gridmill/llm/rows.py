"""Telling rows of any table apart, under names that no column of it has."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.session import cut_lineage


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores behind it as it takes to be new to the tables."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that is different in every row, and the same whenever it is read;
    and that column's name.

    A row that comes straight from a file is told by the file and its place there, so
    nothing is written. Other tables are written once, with a number for each row.
    """
    name = free_name("_row", docs)
    try:
        at = docs.metadataColumn("_metadata")
        placed = docs.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")))
        placed.schema  # noqa: B018  analysed here, whether it can be
        return placed, name
    except AnalysisException:
        return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name
