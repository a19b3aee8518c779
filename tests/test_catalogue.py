"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def values(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert values(got.collect(), got.columns) == values(want.fetchall(), names)


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 200 and out.columns[:2] == ["doc_id", "family"]
