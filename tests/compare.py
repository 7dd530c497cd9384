"""Order-insensitive comparison of a Spark result with the oracle's."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else (round(number, 9) + 0.0)
    return value if isinstance(value, str) else str(value)


def table_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    result = con.execute(sql)
    expected_columns = [c[0] for c in result.description]
    expected = table_of(expected_columns, result.fetchall())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    found = table_of(df.columns, df.collect())
    if len(found) != len(expected):
        return f"{len(found)} rows, expected {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
