"""Every registered query that SQL can express against its SQL counterpart on the smallest tables; the others have tests of their own."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _text(v):
    return "null" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    sql = entry_points.oracle_sql()[name]
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(_text(x[i]) for i in at) for x in found.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
