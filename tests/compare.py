"""Run a catalog query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def expected(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return rows_of(cols, rel.fetchall())


def actual(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def kinds(df, con, sql):
    """(spark type, SQL type) per column where the broad kind differs."""
    broad = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int",
             "hugeint": "int", "double": "float", "float": "float", "string": "text",
             "varchar": "text", "boolean": "bool"}
    spark = dict(df.dtypes)
    duck = {r[0]: r[1].lower() for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (spark[c], duck.get(c)) for c in spark
            if broad.get(spark[c], spark[c]) != broad.get(duck.get(c, "?"), duck.get(c, "?"))}
