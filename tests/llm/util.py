"""Compares a query with its SQL as run by DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = c.execute(sql)
    return [x[0] for x in cur.description], cur.fetchall()


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def assert_same(df, sql, sf):
    names, rows = duck(sql, sf)
    assert sorted(names) == sorted(df.columns)
    got = sorted((rounded(r) for r in df.select(*names).collect()), key=repr)
    want = sorted((rounded(r) for r in rows), key=repr)
    assert len(got) == len(want)
    assert got == want
