"""A registered query against its DuckDB SQL."""

import glob
import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata"


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(value(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        files = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), Counter(tuple(value(r[i]) for i in at) for r in cursor.fetchall())


def same(spark, query, sql, folder):
    cols, got = rows_of(query(spark, folder))
    names, want = duck_rows(sql, folder)
    assert cols == names
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return got
