"""The numbered queries that SQL can state, against DuckDB."""

from __future__ import annotations

import os

import pytest

from quirework.llm import queries
from tests.oracle import rows, tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    result = queries.queries()[name](spark, FOLDER).toPandas()
    expected = tables(FOLDER).execute(queries.oracle_sql()[name]).df()
    assert sorted(result.columns) == sorted(expected.columns)
    assert rows(result) == rows(expected)


@pytest.mark.parametrize(("name", "columns"), [("p2_found", ["src", "row_id", "pii_type", "value"]), ("p3_found", ["span_id", "noise_type", "fixed"]), ("p7_found", ["edit_id_a", "edit_id_b"]), ("p8_ids", ["doc_id", "ids"]), ("p10_found", ["doc_id"])])
def test_columns(spark, name, columns):
    result = queries.queries()[name](spark, FOLDER)
    assert result.columns == columns
    assert result.count() == result.distinct().count() > 0
