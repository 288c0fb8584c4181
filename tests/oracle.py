"""Compare registered queries with their SQL, run by DuckDB on the same files."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(normal(r[k]) for k in order) for r in rows), key=repr)


def same_rows(df, con, sql):
    got = df.collect()
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    want = rows_of(found.columns, found.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in got]) == want
    return len(want)
