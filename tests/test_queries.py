"""Every query with SQL against DuckDB on the smallest data, and every other one for its rows."""

import math
import os

import duckdb
import pytest

from corpusmill.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(found, columns):
    return sorted((tuple(map(value, r)) for r in found), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, base, name):
    want = base.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(*[f"`{c}`" for c in columns]).collect(), columns) == rows(base.sql(f"select {quoted} from ({catalog.ORACLES[name]})").fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
