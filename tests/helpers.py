"""Compare a query with its SQL on the smallest tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def oracle(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return rows(names, cursor.fetchall())


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=repr)


def result(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
