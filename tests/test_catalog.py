"""Every registered query against DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tempora.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()]
    assert sorted(rows, key=key) == sorted(result.fetchall(), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "metrics"), [("raw_select", "'click', 'view'"), ("align_metrics", "'click', 'view', 'purchase'"), ("sql_raw", "'click'"), ("table_select", "'click'")])
def test_whole_queries_read_all_users_and_days(spark, duck, name, metrics):
    rows = catalog.QUERIES[name](spark, SF).select("lset", "time").collect()
    seen = {(r["lset"], (r["time"] - catalog.START) // catalog.DAY) for r in rows}
    wanted = duck.execute(f"SELECT DISTINCT lset, (t - {catalog.START}) // {catalog.DAY} FROM ({catalog.EVENTS}) WHERE metric IN ({metrics}) AND t BETWEEN {catalog.START} AND {catalog.STOP}").fetchall()
    assert seen == set(wanted)
