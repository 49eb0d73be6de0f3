"""Rows of a Spark query and of its SQL in one canonical, order-free form."""

import math
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, Decimal):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(canonical(row[c]) for c in columns) for row in df.collect())


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(canonical(row[i]) for i in at) for row in cursor.fetchall())
