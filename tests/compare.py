"""A query's rows against DuckDB's for its SQL."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def kind(t):
    t = str(t).lower()
    return {"varchar": "string", "bigint": "bigint", "hugeint": "hugeint", "integer": "int", "double": "double", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}.get(t, t)


def check(df, sql, connection):
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = connection.execute(sql)
    have = [d[0] for d in rel.description]
    assert sorted(have) == names, (sorted(have), names)
    kinds = {d[0]: kind(d[1]) for d in rel.description}
    want = Counter(tuple(plain(r[have.index(n)]) for n in names) for r in rel.fetchall())
    assert got == want, (sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3])
    mine = {k: kind(v) for k, v in df.dtypes}
    assert mine == kinds, {k: (mine[k], kinds[k]) for k in mine if mine[k] != kinds[k]}
