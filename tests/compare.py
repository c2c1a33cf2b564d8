"""Row-level comparison of a Spark query with its DuckDB twin."""

import glob
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def canon(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols, (names, cols)
    want = Counter(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
