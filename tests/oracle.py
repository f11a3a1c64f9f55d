"""Comparison of a query with its SQL in DuckDB, by sorted normalised rows."""

import decimal
import glob
import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def both(query, sql, spark, sf_dir, con):
    """Rows of the query and of its SQL, in comparable form."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()), sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
