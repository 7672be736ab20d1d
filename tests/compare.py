"""Rows of a query against rows of its SQL on the same tables."""

from __future__ import annotations

import glob
import os

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(spark, con, query, sql: str) -> None:
    df = query(spark, DATA)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda rows, order: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[k] for k in order)) for r in rows), key=str)
    want = plain(cursor.fetchall(), [names.index(c) for c in sorted(names)])
    got = plain(df.select(sorted(df.columns)).collect(), range(len(names)))
    assert got == want


def has_data() -> bool:
    return bool(glob.glob(f"{DATA}/*.parquet"))
