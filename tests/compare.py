"""Runs a query and its SQL over the same tables and compares the rows, columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return tuple((v is not None, str(type(v)) if v is None else "", repr(v)) for v in row)


def normal(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return normal([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return normal(df.columns, [tuple(r) for r in df.collect()])


def assert_same(df, sql: str, sf_dir: str) -> int:
    a, b = spark_rows(df), sql_rows(sql, sf_dir)
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]), [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3])
    for x, y in zip(a[1], b[1]):
        assert x == y, (x, y)
    return len(a[1])
