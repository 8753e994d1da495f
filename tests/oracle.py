"""Runs a query and its SQL on the same tables and compares rows, names and values."""

from pathlib import Path

import duckdb


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def connect(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


def same(spark, sf, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    r = connect(sf).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want
