"""Row comparison helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_digest(cols: Sequence[str]) -> Column:
    """md5 of a row; NULL and the empty string differ.

    Each value is led by its length, so no text in one column can pass for the end of it
    and the start of the next.
    """

    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("n"))

    return F.md5(F.concat(F.lit(""), *[part(c) for c in cols]))


def rows_hash(cols: Sequence[str]) -> Column:
    """Order-free hash of a set of rows, as an aggregate.

    Rows are taken as text, the form in which they are archived; NULL and the empty
    string differ.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    return F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))


def pg_order(*cols: str) -> list[Column]:
    """Sort keys with PostgreSQL null order; a leading '-' means descending."""
    return [
        F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last()
        for c in cols
    ]
