"""Comparison of a Spark query with its SQL on DuckDB."""

import math
import os

import duckdb

DATA = "/root/testdata"


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def compare(spark, sf, query, statement):
    d = f"{DATA}/{sf}"
    df = query(spark, d)
    cols = sorted(df.columns)
    ours = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in os.listdir(d):
        con.execute(f"create view {p.split('.')[0]} as select * from '{d}/{p}'")
    rel = con.sql(statement)
    names = rel.columns
    theirs = sorted((tuple(normal(dict(zip(names, r))[c]) for c in sorted(names)) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols
    assert ours == theirs
