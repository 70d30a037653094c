"""Runs a query in Spark and its SQL in DuckDB and compares rows, order apart."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in os.listdir(folder):
        name, path = t.removesuffix(".parquet"), f"{folder}/{t}"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def normal(rows):
    one = lambda x: round(x, 8) if isinstance(x, float) else x
    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, con, sql):
    columns = sorted(df.columns)
    got = normal(map(tuple, df.select(*columns).collect()))
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == normal([row[i] for i in at] for row in r.fetchall())
