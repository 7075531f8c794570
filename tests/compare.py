"""Spark rows against DuckDB rows of the same tables, whatever their order."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).iterdir()):
        if p.suffix == ".parquet":
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def assert_same(df, sql: str, sf_dir: str) -> int:
    """The number of rows, if names and rows agree."""
    con = connect(sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    ours = sorted((tuple(_plain(x) for x in r) for r in df.select(*order).toLocalIterator()), key=repr)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (a, b)
    return len(ours)
