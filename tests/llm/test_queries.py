from __future__ import annotations

import pytest

import __spark_entry__ as entry
from gridmill.llm import ORACLES, QUERIES
from compare import duck, rows_of


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck(sf).execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
