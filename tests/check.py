"""Compare a Spark result with its SQL twin: column names, types, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def duck(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def norm(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def compare(spark_df, connection, sql) -> list[str]:
    """Differences as text; empty when equal."""
    problems = []
    result = connection.execute(sql)
    sql_columns = {d[0]: str(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    spark_types = dict(spark_df.dtypes)
    if sorted(spark_types) != sorted(sql_columns):
        return [f"columns {sorted(spark_types)} vs {sorted(sql_columns)}"]
    for name, kind in sql_columns.items():
        expected = _TYPES.get(kind, kind)
        if spark_types[name] != expected and not (expected, spark_types[name]) == ("timestamp_ntz", "timestamp"):
            problems.append(f"type of {name}: spark {spark_types[name]}, sql {kind}")
    names = sorted(spark_types)
    order = list(sql_columns)
    ours = Counter(tuple(norm(r[n]) for n in names) for r in spark_df.collect())
    theirs = Counter(tuple(norm(r[order.index(n)]) for n in names) for r in sql_rows)
    if ours != theirs:
        problems.append(
            f"rows {sum(ours.values())} vs {sum(theirs.values())}; columns {names}; only spark {list((ours - theirs).items())[:3]}; only sql {list((theirs - ours).items())[:3]}"
        )
    return problems
