"""Every query with SQL against DuckDB on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted(tuple(str(clean(r[k])) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    expected = duck.execute(catalog.SQL[name])
    names = [c[0] for c in expected.description]
    assert rows(found.columns, found.collect()) == rows(names, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
