"""Runs a query and its SQL on the smallest tables and compares all rows."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def same(spark, query, sql: str, data: str = DATA) -> bool:
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    got, want = query(spark, data).toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return False
    rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
    return rows(got) == rows(want)
