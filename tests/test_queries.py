"""Every registered query on the smallest tables, against its SQL where it has one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import checks

SMALL = "/root/testdata/sf0.001"
checks.load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def test_registry():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, db, name):
    df = checks.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in checks.ORACLE:
        relation = db.sql(checks.ORACLE[name])
        assert sorted(relation.columns) == columns
        places = [relation.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 5 * df.select("query_id").distinct().count() > 0
