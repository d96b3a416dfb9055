"""Run a query on Spark and its SQL on DuckDB over the same files, and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"create view {name} as select * from read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    plain = [tuple(_plain(row[at]) for at in order) for row in rows]
    return sorted(plain, key=repr)


# Type classes that both engines must agree on.
_KINDS = {"bigint": "int", "int": "int", "integer": "int", "double": "float", "string": "text", "varchar": "text",
          "boolean": "bool", "date": "date"}


def differences(df, db, sql: str) -> list[str]:
    """Empty when both sides have the same columns, types and rows."""
    cursor = db.execute(sql)
    names = [item[0] for item in cursor.description]
    kinds = {item[0]: _KINDS.get(str(item[1]).lower(), str(item[1]).lower()) for item in cursor.description}
    theirs = rows_of(names, cursor.fetchall())
    spark_kinds = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    found = []
    if spark_kinds != kinds:
        wrong = {k: (spark_kinds.get(k), kinds.get(k)) for k in {*spark_kinds, *kinds} if spark_kinds.get(k) != kinds.get(k)}
        found.append(f"schema (spark, sql): {wrong}")
    ours = rows_of(df.columns, df.collect())
    if len(ours) != len(theirs):
        found.append(f"rows: spark {len(ours)}, sql {len(theirs)}")
    if ours != theirs:
        one, other = set(ours), set(theirs)
        found.append(f"only spark: {sorted(one - other, key=repr)[:3]}")
        found.append(f"only sql: {sorted(other - one, key=repr)[:3]}")
    return found
