"""Every registered query runs over the smallest tables, and equals its SQL where it has one."""

import decimal
import os

import numpy as np
import pandas as pd
import pytest

from quarry.plans import catalog

SF = os.environ.get("QUARRY_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value as text that compares across engines."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return "~"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, decimal.Decimal, np.integer, np.floating)):
        return repr(round(float(value), 5))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_names_match():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLES:
        return
    result = duck.sql(catalog.ORACLES[name])
    names = list(result.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
