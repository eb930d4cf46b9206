"""Rows of a Spark query and of DuckDB SQL in one form, whatever their order."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        return "{" + ",".join(map(plain, v)) + "}"
    if isinstance(v, dict):
        return "{" + ",".join(map(plain, v.values())) + "}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(tuple(plain(row[i]) for i in at) for row in r.fetchall())
