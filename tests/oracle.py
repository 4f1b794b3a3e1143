"""Run a registered query and its SQL and compare them value by value."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


KINDS = {
    "bigint": ("BIGINT", pa.int64()),
    "int": ("INTEGER", pa.int32()),
    "double": ("DOUBLE", pa.float64()),
    "string": ("VARCHAR", pa.string()),
    "boolean": ("BOOLEAN", pa.bool_()),
}


def _sorted(table: pa.Table, schema: pa.Schema) -> pa.Table:
    table = table.select(schema.names).cast(schema).combine_chunks()
    return table.sort_by([(name, "ascending") for name in schema.names])


def compare(df, con, text) -> str:
    """Empty if equal, else what differs first."""
    result = con.sql(text)
    sql_types = dict(zip(result.columns, map(str, result.types)))
    if sorted(df.columns) != sorted(sql_types):
        return f"columns {sorted(df.columns)} vs {sorted(sql_types)}"
    for name, kind in df.dtypes:
        if KINDS[kind][0] != sql_types[name]:
            return f"type of {name}: {kind} vs {sql_types[name]}"
    expected = result.to_arrow_table()
    got = df.toArrow()
    if len(got) != len(expected):
        return f"rows {len(got)} vs {len(expected)}"
    schema = pa.schema([(name, KINDS[kind][1]) for name, kind in sorted(df.dtypes)])
    a, b = _sorted(got, schema), _sorted(expected, schema)
    if a.equals(b):
        return ""
    wrong = [(x, y) for x, y in zip(a.to_pylist(), b.to_pylist()) if x != y]
    return f"{len(wrong)} of {len(a)} rows, first {wrong[0]}" if wrong else ""
