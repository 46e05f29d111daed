import math
import os

import duckdb
import pytest

import __spark_entry__
import quillon
from quillon import queries


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for f in os.listdir(sf):
        out.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return out


def rows(table):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in table), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_has_the_same_rows(spark, sf, con, name):
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    frame = queries.QUERIES[name](spark, sf)
    assert sorted(frame.columns) == sorted(columns)
    assert rows(map(tuple, frame.select(columns).collect())) == rows(found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_version():
    assert quillon.__version__ == "0.1.0"
