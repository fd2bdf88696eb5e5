"""Registered queries against their SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(rows, columns):
    def cell(x):
        if isinstance(x, float):
            return round(x, 9)
        if isinstance(x, (list, tuple)):
            return tuple(map(cell, x))
        if isinstance(x, dict):
            return tuple(sorted((k, cell(v)) for k, v in x.items()))
        return x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(columns), (name, df.columns, columns)
    got = [tuple(r) for r in df.collect()]
    assert rounded(got, df.columns) == rounded(want, columns), name
    return len(got)
