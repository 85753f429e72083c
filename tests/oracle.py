"""Comparison of a query with its DuckDB statement on the same tables."""

from __future__ import annotations

import os

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    """A connection with every parquet table of the folder as a view."""
    connection = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{files}')")
    return connection


def _value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(frame) -> list[tuple[str, ...]]:
    """Rows as sorted tuples of text, columns in the order of their names."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_value, row)) for row in frame.itertuples(index=False))
