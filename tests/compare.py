"""Runs a query on Spark and its SQL on DuckDB and compares all rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return db


def by_name(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(row[i] for i in order) for row in rows]
    # Types count: 1 and 1.0 differ.
    return [columns[i] for i in order], sorted(map(repr, rows))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return by_name(df.columns, [tuple(r) for r in df.collect()])


def duckdb_rows(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    return by_name(columns, cursor.fetchall())
