"""Bars and comparisons shared by the tests."""

from __future__ import annotations

import math
import os
from datetime import datetime, timedelta

import duckdb

BAR = "symbol string, row_idx long, timestamp timestamp_ntz, open double, high double, low double, close double, volume long"
T3 = [(100, 105, 98, 102, 1000), (102, 107, 100, 104, 1200), (104, 109, 102, 106, 1100)]
K5 = [*T3, (106, 111, 104, 108, 1300), (108, 113, 106, 110, 1400)]
D8 = [*K5, (200, 205, 198, 202, 1000), (202, 207, 200, 204, 1200), (204, 209, 202, 206, 1100)]
H6 = [*T3, (90, 95, 88, 92, 800), (92, 97, 90, 94, 900), (94, 99, 92, 96, 850)]
G9 = [*H6, (110, 115, 108, 112, 1500), (112, 117, 110, 114, 1600), (114, 119, 112, 116, 1400)]


def bars(spark, rows, symbol="x", start=datetime(2024, 1, 1), step=timedelta(hours=1)):
    """Bars from (open, high, low, close, volume) in order."""
    return spark.createDataFrame([(symbol, k, start + k * step, *map(float, r[:4]), int(r[4])) for k, r in enumerate(rows)], BAR)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def same(df, con, sql):
    """The rows of both, as sorted tuples with columns by name, ordered by what isn't a double first."""
    names = sorted(df.columns)
    cur = con.execute(sql)
    own = [d[0] for d in cur.description]
    assert sorted(own) == names
    at = [own.index(n) for n in names]
    key = lambda row: (tuple((x is None, str(x)) for x in row if not isinstance(x, float)), tuple(x for x in row if isinstance(x, float)))
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=key)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    return ours, theirs


def close(ours, theirs):
    """Equal but for the last digit that both round to."""
    alike = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))
    return len(ours) == len(theirs) and all(alike(a, b) for p, q in zip(ours, theirs, strict=True) for a, b in zip(p, q, strict=True))
