"""Run a query and its SQL side by side and report the first difference."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    from siteglass.plans.catalog import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    if isinstance(value, dt.datetime):
        return "timestamp"
    if isinstance(value, dt.date):
        return "date"
    return type(value).__name__


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple], dict[str, set]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds: dict[str, set] = {columns[i]: set() for i in order}
    out = []
    for row in rows:
        for i in order:
            if row[i] is not None:
                kinds[columns[i]].add(kind(row[i]))
        out.append(tuple(plain(row[i]) for i in order))
    return [columns[i] for i in order], sorted(out), kinds


def difference(spark, con, build, sql: str, folder: str) -> tuple[str | None, int]:
    """None when both sides agree, else a short description; and the row count."""
    df = build(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", len(left[1])
    for column in left[0]:
        if left[2][column] and right[2][column] and left[2][column] != right[2][column]:
            return f"type of {column}: {left[2][column]} != {right[2][column]}", len(left[1])
    if len(left[1]) != len(right[1]):
        extra = set(left[1]) ^ set(right[1])
        return f"rows {len(left[1])} != {len(right[1])}: {sorted(extra)[:3]}", len(left[1])
    for a, b in zip(left[1], right[1]):
        if a != b:
            cells = [(c, x, y) for c, x, y in zip(left[0], a, b) if x != y]
            return f"values {cells[:4]} in {a[:6]}", len(left[1])
    return None, len(left[1])
