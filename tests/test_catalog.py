"""Every query against its SQL on a second engine, whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import duck, rows_of
from gridmill.catalog import ORACLES, QUERIES


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
