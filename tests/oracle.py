"""Compare a query's result with its SQL counterpart run by DuckDB."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(value) -> str:
    if isinstance(value, float):
        return f"{value:.6f}"
    return repr(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(
        hashlib.md5("|".join(_value(row[i]) for i in order).encode()).hexdigest() for row in rows
    )


def expected(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    return [column[0] for column in result.description], result.fetchall()
