"""Runs a query on Spark and its SQL on DuckDB over the same files and compares rows, names and types."""

from __future__ import annotations

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def rows_of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    rows = [tuple(float(r[i]) if isinstance(r[i], decimal.Decimal) else r[i] for i in order) for r in found.fetchall()]
    return sorted(found.columns), dict(zip(found.columns, map(str, found.types))), sorted(rows, key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    sql_names, sql_types, sql_rows = rows_of_sql(sql, sf_dir)
    assert names == sql_names
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == sql_types
    assert rows == sql_rows
    return len(rows)
