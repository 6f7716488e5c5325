"""Runs a query and its SQL on one folder of tables and compares their rows."""

import glob
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


def key(row):
    return tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(key([r[c] for c in cols]) for r in df.collect())


def sql_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    return cols, sorted(key([row[names.index(c)] for c in cols]) for row in r.fetchall())
