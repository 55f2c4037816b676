"""Rows of a Spark query against rows of its SQL."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(path + '/*.parquet') or [path]})")
    return con


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in at) for r in data), key=repr)


def check_query(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())
    return got
