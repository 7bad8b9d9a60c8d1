"""Every registered query against its SQL, over the smallest tables, as the driver compares them."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans.queries import ORACLE_SQL, QUERIES


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLE_SQL:
        compare(spark, sf, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
