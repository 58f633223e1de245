"""Rows of a query next to those of its SQL, compared without regard to order."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "NaN" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    return str(value)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    ours = sorted(tuple(plain(row[n]) for n in names) for row in (r.asDict(True) for r in df.collect()))
    answer = con.execute(sql)
    theirs_names = [d[0] for d in answer.description]
    assert sorted(theirs_names) == names
    places = [theirs_names.index(n) for n in names]
    theirs = sorted(tuple(plain(row[i]) for i in places) for row in answer.fetchall())
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not different, different[:2]
