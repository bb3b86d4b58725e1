"""The driver's comparison in small: the same rows from Spark and from DuckDB, in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, bool) or str(type(x)).endswith("bool'>") or str(x) in ("True", "False"):
        return str(bool(x))
    try:
        return f"{float(x):.9g}"
    except (TypeError, ValueError):
        return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_cell(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


def same(df, sql, path):
    a, b = df.toPandas(), views(path).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
