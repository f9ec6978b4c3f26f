"""Run registered queries beside their SQL in DuckDB and compare rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.10g}"
    return str(v)


def differences(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(plain(x) for x in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
    if ours != theirs:
        odd = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return f"{len(ours)} and {len(theirs)} rows; first difference {odd}"
    return ""
