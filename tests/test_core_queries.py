"""Every core query with a statement against DuckDB; the others for their rows."""

from __future__ import annotations

import os

import pytest

from quirework.plans import catalog
from tests.oracle import rows, tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    result = catalog.queries()[name](spark, FOLDER).toPandas()
    if statement := catalog.oracle_sql().get(name):
        expected = tables(FOLDER).execute(statement).df()
        assert sorted(result.columns) == sorted(expected.columns)
        assert rows(result) == rows(expected)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
