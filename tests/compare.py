"""Runs a registered query and its SQL twin and compares the results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=_key)


# Equivalent type names of the two engines.
KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
}


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types and rows agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns: {sorted(df.columns)} against {sorted(names)}"]
    found = []
    for name, kind in dict(df.dtypes).items():
        if KINDS.get(kinds[name], kinds[name]) != kind:
            found.append(f"type of {name}: {kind} against {kinds[name]}")
    if len(got) != len(want):
        return [*found, f"rows: {len(got)} against {len(want)}"]
    a, b = _sorted(got, df.columns), _sorted(want, names)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        found.append(f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}")
    return found
