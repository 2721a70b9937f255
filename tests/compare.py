"""Query results against SQL, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def views(folder):
    connection = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return float(value) if hasattr(value, "as_tuple") else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def check(spark, connection, folder, query, sql):
    df = query(spark, str(folder))
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, answer.fetchall())
