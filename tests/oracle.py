"""Compares a Spark query's rows with those that DuckDB gives for its SQL."""

import decimal
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(folder: str):
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, connection, sql: str) -> None:
    result = connection.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())
