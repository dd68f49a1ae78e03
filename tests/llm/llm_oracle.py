"""Spark results beside DuckDB's."""

import collections
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, module, name, folder="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(module.ORACLE_SQL[name])
    got = module.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = collections.Counter(tuple(r[c] for c in columns) for r in got.collect())
    theirs = collections.Counter(tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall())
    assert mine == theirs
