"""Run a query in Spark and its oracle in DuckDB and compare the rows."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key), [columns[i] for i in order]


def compare(df, con, sql):
    """None if equal, else a short account of the difference."""
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first only in spark {list(set(got) - set(want))[:3]}, only in duckdb {list(set(want) - set(got))[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. spark {bad[0][0]} duckdb {bad[0][1]}"
    return None
