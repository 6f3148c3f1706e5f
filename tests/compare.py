"""Rows of a Spark frame and of an oracle's SQL, comparable."""

import glob
import math
import os

import duckdb


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{files}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
