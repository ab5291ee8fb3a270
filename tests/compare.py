"""Comparison of a Spark result with the DuckDB statement over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{directory}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    return value


def _order(row):
    return [(v is None, str(type(v)), str(v)) for v in row]


def rows_of(names: list[str], rows) -> list[tuple]:
    index = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in index) for r in rows), key=_order)


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def difference(df, con, sql: str) -> str | None:
    """What differs between the two results, or None."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]).split("(")[0] for d in result.description}
    expected = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    got = rows_of(df.columns, df.collect())
    if len(got) != len(expected):
        return f"{len(got)} rows <> {len(expected)}; spark only {[r for r in got if r not in expected][:2]}, sql only {[r for r in expected if r not in got][:2]}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{sorted(names)}: spark {a} <> sql {b}"
    off = {n: (t, types[n]) for n, t in df.dtypes if SPARK_TYPES.get(t, t) not in types[n].upper() and types[n].upper() not in SPARK_TYPES.get(t, t)}
    if off and expected:
        return f"types {off}"
    return None
