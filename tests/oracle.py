"""Spark results against DuckDB on the same tables."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql, sf_dir):
    """Empty if both agree; else what doesn't."""
    cursor = connection(sf_dir).execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if columns != want_columns:
        return f"columns {columns} and {want_columns}"
    if got != want:
        return f"{sum(got.values())} rows and {sum(want.values())}; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""
