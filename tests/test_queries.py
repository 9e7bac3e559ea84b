"""Every relational query against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from stanceframe.plans import registry

SF = "/root/testdata/sf0.001"


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) if isinstance(v, float) else tuple(map(value, v)) if isinstance(v, (list, tuple)) else v

    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_sql_gives(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    sql = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(got.columns)
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(sql.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
