"""Exact comparison of a Spark result with a DuckDB statement."""

from __future__ import annotations

import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events".split()


def _normal(table: pa.Table) -> pa.Table:
    names = sorted(table.column_names)
    table = table.select(names)
    fields = []
    for field in table.schema:
        kind = field.type
        if pa.types.is_large_string(kind) or pa.types.is_null(kind):
            kind = pa.string()
        fields.append(pa.field(field.name, kind))
    table = table.cast(pa.schema(fields)).combine_chunks()
    return table.sort_by([(n, "ascending") for n in names]) if table.num_rows else table


def spark_table(df) -> pa.Table:
    return _normal(df.toArrow())


def duck_table(connection, sql: str) -> pa.Table:
    return _normal(connection.sql(sql).to_arrow_table())


def differences(df, connection, sql: str) -> str | None:
    """What differs, or None when names, types and the multiset of rows are equal."""
    ours, theirs = spark_table(df), duck_table(connection, sql)
    if ours.schema.remove_metadata() != theirs.schema.remove_metadata():
        pairs = [(a, b) for a, b in zip(ours.schema, theirs.schema) if a != b]
        return f"schema: {pairs or (ours.column_names, theirs.column_names)}"
    if ours.num_rows != theirs.num_rows:
        return f"rows: {ours.num_rows} != {theirs.num_rows}"
    if ours.equals(theirs):
        return None
    for a, b in zip(ours.to_pylist(), theirs.to_pylist()):
        if a != b:
            return f"value: {a} != {b}"
    return "chunks differ"


def star_views(connection, folder: str) -> None:
    for name in TABLES:
        connection.sql(f"create or replace view {name} as select * from '{folder}/{name}.parquet'")
