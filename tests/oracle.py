"""Runs a query and its SQL over one folder and compares schema names and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, query, sql: str, folder: str = DATA) -> None:
    df = query(spark, folder)
    cur = connect(folder).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert ours == theirs
