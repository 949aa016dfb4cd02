"""Compares a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same_rows(df, sql, sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert own == other
