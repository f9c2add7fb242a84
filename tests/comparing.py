"""Spark's rows against DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def duck(sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def bag(rows):
    return sorted(map(repr, rows))


def assert_same(df, sql, con):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    assert bag(tuple(r[c] for c in columns) for r in df.collect()) == bag(want)
