"""Every registered capture query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from capture_tables.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in fixtures.TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, (list, np.ndarray)):
        return tuple(map(normal, value))
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.integer, np.floating)):
        return round(float(value), 5) + 0.0
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([normal(v) for v in r]) for r in frame.values.tolist())


def almost(a, b):
    """Rows that differ by rounding alone count as equal."""
    if a == b:
        return True
    x, y = eval(a), eval(b)  # noqa: S307  our own reprs
    return all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    wanted = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = rows(found), rows(wanted)
    assert len(a) == len(b)
    assert all(map(almost, a, b))


def test_flagship_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
