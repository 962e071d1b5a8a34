"""Run registered queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


# Names of the same types in both engines.
_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


def difference(spark_frame, connection, sql: str) -> str | None:
    """What differs between a frame and its SQL; ``None`` when nothing does."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(names)}"
    kinds = {d[0]: _TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    other = {n: (k, kinds[n]) for n, k in spark_frame.dtypes if k != kinds[n]}
    if other:
        return f"types {other}"
    actual = _rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    expected = _rows(names, connection.execute(sql).fetchall())
    if not expected:
        return "the SQL gives no rows, so nothing is checked"
    if actual != expected:
        first = next(((a, e) for a, e in zip(actual, expected) if a != e), None)
        return f"{len(actual)} rows against {len(expected)}; first difference {first}"
    return None
