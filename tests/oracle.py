"""Run a query and its SQL over the same tables and compare rows without order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    """Rows by column name, in an order that small differences don't change."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    coarse = lambda r: str(tuple(round(v, 3) + 0.0 if isinstance(v, float) else v for v in r))
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=coarse)


def close(x, y):
    """Equal, or one unit of the last digit apart: queries round to six digits, some to four."""
    if not (isinstance(x, float) and isinstance(y, float)):
        return x == y
    four = all(abs(v * 1e4 - round(v * 1e4)) < 1e-6 for v in (x, y))
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1.1e-4 if four else 1.1e-6)


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    assert len(mine) == len(theirs)
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(close, a, b))]
    assert not bad, bad[:3]
