"""Every registered query that has a DuckDB twin, against it, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from setwise import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "orders", "customer", "supplier")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return connection


def canonical(frame):
    def one(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"e7_experiment", "t7_dynamic_growth"}))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count()


def test_entry_has_all_of_them():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
