"""Queries whose SQL DuckDB can run, on the driver's comparison tables."""

import duckdb
import pytest

from lorebase import llm

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{PATH}/{name_}.parquet'")
    cursor = con.execute(llm.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    got = llm.queries()[name](spark, PATH).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_every_operator_has_one_query():
    names = list(llm.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
