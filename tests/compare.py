"""Rows of a query and of its SQL in one comparable form."""

import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        p = os.path.join(sf, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, sf, con, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(sql)
    want = rows([d[0] for d in r.description], r.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
