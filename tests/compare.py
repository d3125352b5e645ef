"""Rows of Spark and DuckDB in one comparable form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    r = c.sql(sql)
    return list(r.columns), r.fetchall()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}") if isinstance(v, float) else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def same(df, sql, sf_dir):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(*oracle(sql, sf_dir))
