"""Run registered queries next to their SQL counterparts and compare rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.6f}".replace("-0.000000", "0.000000")
    return "null" if x is None else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_value(r[i]) for i in order) for r in rows)


def kinds(types):
    table = {
        "string": "s", "varchar": "s", "bigint": "i", "long": "i", "int": "int", "integer": "int",
        "double": "f", "float": "f32", "boolean": "b", "hugeint": "huge",
    }
    return [table.get(str(t).lower(), str(t).lower()) for t in types]


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, kinds([d[1] for d in result.description])))
    want_cols, want = rows_of(names, result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    spark_types = {n: k for (n, _), k in zip(df.dtypes, kinds([t for _, t in df.dtypes]))}
    if spark_types != types:
        return f"types {[(c, spark_types[c], types[c]) for c in got_cols if spark_types[c] != types[c]]}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    return None
