"""Runs SQL in DuckDB over a folder of tables and compares rows with a DataFrame's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql, folder):
    c = duckdb.connect()
    for t in TABLES:
        f = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(repr(tuple(x[i] for i in order)) for x in r.fetchall())


def same(df, sql, folder):
    names, want = rows(sql, folder)
    assert sorted(df.columns) == names
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want
    return len(want)
