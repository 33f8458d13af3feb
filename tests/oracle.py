"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {
    "tinyint": "TINYINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types and all rows agree."""
    cur = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    got = df.collect()
    out = []
    if set(got_types) != set(want_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    bad = {c: (got_types[c], want_types[c]) for c in got_types if got_types[c] != want_types[c]}
    if bad:
        out.append(f"types {bad}")
    if len(got) != len(want):
        return [*out, f"rows {len(got)} != {len(want)}"]
    g = _rows(df.columns, got)
    w = _rows([d[0] for d in cur.description], want)
    wrong = [(a, b) for a, b in zip(g, w) if a != b]
    if wrong:
        out.append(f"{len(wrong)} of {len(g)} rows differ, columns {sorted(df.columns)}: {wrong[:3]}")
    return out
