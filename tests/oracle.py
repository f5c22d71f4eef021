"""Runs a query and its SQL twin over the same tables and compares the rows."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_cell(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _cell(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if hasattr(x, "asDict"):
        return _cell(x.asDict())
    return x


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name, at = f.removesuffix(".parquet"), f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """An empty string if both give the same rows under the same column names."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = Counter(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(_cell(row[i]) for i in at) for row in rel.fetchall())
    if ours == theirs:
        return ""
    return f"{cols}: only ours {list((ours - theirs).items())[:4]} of {sum((ours - theirs).values())}, only SQL {list((theirs - ours).items())[:4]} of {sum((theirs - ours).values())}; ours {sum(ours.values())}, SQL {sum(theirs.values())}"
