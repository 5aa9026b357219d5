"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from lorebase.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) if not isinstance(v, bool) else v


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(t[i]) for i in order) for t in tuples), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, duck, data, name):
    df = catalogue.queries()[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
