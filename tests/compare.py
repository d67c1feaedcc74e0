"""Compare registered queries with their SQL on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    """The value with its type, so that 5 and 5.0 differ; doubles to nine digits."""
    if isinstance(value, float):
        value = "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return type(value).__name__, value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql) -> str | None:
    """None when both answers have the same columns and the same rows, else what differs."""
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    expected, found = rows_of(names, answer.fetchall()), rows_of(df.columns, df.collect())
    if expected == found:
        return None
    extra, missing = list((found - expected).items())[:3], list((expected - found).items())[:3]
    return f"{found.total()} rows, expected {expected.total()}; only here {extra}; only in SQL {missing}"
