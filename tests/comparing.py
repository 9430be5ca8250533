"""Rows of a Spark query and of its SQL in one form."""

from __future__ import annotations

import decimal
import math

import duckdb

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 9))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def of_sql(sql: str, folder: str = FOLDER) -> tuple[list[str], list[list[str]]]:
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = connection.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return [found.columns[k] for k in order], sorted([plain(row[k]) for k in order] for row in found.fetchall())


def of_spark(df) -> tuple[list[str], list[list[str]]]:
    columns = sorted(df.columns)
    return columns, sorted([plain(row[c]) for c in columns] for row in df.collect())
