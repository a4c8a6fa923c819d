"""Where the order tables lie, and lifecycle tables as both engines see them."""

from __future__ import annotations

import duckdb

from spanledger.registry import Inputs

STAR = "/root/testdata/sf0.001"


def lifecycle_db(tables):
    """The same lifecycle tables in DuckDB."""
    connection = duckdb.connect()
    for name, df in tables.items():
        rows = df.toArrow()
        connection.register(f"{name}_arrow", rows)
        connection.sql(f"create table {name} as select * from {name}_arrow")
    return connection


def both_engines(tables, folder):
    """Operators' inputs and a DuckDB connection over the same tables, stored as one file each."""
    stored = {}
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
        stored[name] = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    return Inputs(stored), lifecycle_db(stored)
