"""Compare registered queries with their SQL oracles in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, int, str, datetime.date)):
        return "NULL" if value is None else str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 9))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def compare(df, con, sql: str) -> tuple[int, str | None]:
    """Row count of the Spark result and what differs from the oracle, if anything."""
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != columns:
        return 0, f"columns differ: {columns} and {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    differing = {
        c: (df.schema[c].dataType.simpleString(), kinds[c])
        for c in columns
        if TYPES.get(df.schema[c].dataType.simpleString()) != kinds[c]
    }
    if differing:
        return 0, f"types differ: {differing}"
    order = [names.index(c) for c in columns]
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    if ours != theirs:
        only = sorted(set(ours) - set(theirs))[:2], sorted(set(theirs) - set(ours))[:2]
        return len(ours), f"{len(ours)} and {len(theirs)} rows; Spark only {only[0]}; oracle only {only[1]}"
    return len(ours), None
