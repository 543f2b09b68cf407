"""Rows of a query and of its SQL, to be compared."""

from __future__ import annotations

import os
from collections import Counter

SF = "/root/testdata/sf0.001"
there = os.path.isdir(SF)


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def both(spark, query, sql: str) -> tuple[list[str], list[str], Counter, Counter]:
    """Column names and rows of Spark's and of DuckDB's result."""
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(SF):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    found = query(spark, SF)
    want = db.sql(sql)
    return sorted(found.columns), sorted(want.columns), _bag(found.columns, found.collect()), _bag(want.columns, want.fetchall())
