"""Runs a query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs: column names, types, row counts, or sample rows of one side only."""
    con.execute(sql)
    names = [d[0] for d in con.description]
    types = {d[0]: str(d[1]) for d in con.description}
    expected = rows_of(names, con.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    found = []
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} against {types[name]}")
    actual = rows_of(df.columns, df.collect())
    if actual != expected:
        found.append(f"rows {sum(actual.values())} against {sum(expected.values())}")
        found += [f"only Spark: {str(r)[:600]}" for r in list(actual - expected)[:2]]
        found += [f"only SQL:   {str(r)[:600]}" for r in list(expected - actual)[:2]]
    return found
