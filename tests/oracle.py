"""Compares a registered query with its DuckDB counterpart, value by value."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(round(r[k], 9) + 0.0) if isinstance(r[k], float) else repr(r[k]) for k in at) for r in rows)


def assert_same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    rel = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows_of(rel.fetchall(), list(rel.columns))
