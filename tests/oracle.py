"""Comparison of a query with its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9) if math.isfinite(x) else str(x)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def rows_of(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(df, con, sql):
    rel = con.execute(sql)
    names, want = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want, names)
