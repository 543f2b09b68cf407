"""Queries against their SQL on the smallest tables."""

import pytest

from tests.oracle import both, there
from trailmark.llm import oracle, queries


@pytest.mark.skipif(not there, reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_and_sql_agree(spark, name):
    columns, want_columns, rows, want = both(spark, queries.queries()[name], oracle.SQL[name])
    assert columns == want_columns and rows == want


def test_sql_of_the_hashes():
    import duckdb
    import xxhash

    parts = [b"", b"a", b"abcdefghijk", b"0123456789abcdef" * 2, "höhe wörter und mehr, länger als zweiunddreißig".encode() * 3]
    db = duckdb.connect()
    db.sql(f"CREATE TABLE s AS SELECT unnest({[p.hex().upper() for p in parts]}) AS x")
    found = dict(db.sql(f"WITH {oracle._xxh64('s').lstrip()} SELECT x, h FROM hashed").fetchall())
    assert found == {p.hex().upper(): xxhash.xxh64_intdigest(p, seed=42) for p in parts}
