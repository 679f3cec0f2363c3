"""Every core query against its SQL on the smallest tables."""

import glob
import numbers

import duckdb
import pandas as pd
import pytest

from routinelens import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


def cells(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda v: "-" if v is None or v is pd.NA or v is pd.NaT or v != v else repr(round(float(v), 6)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(one, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).schema.fieldNames() == ["automation", "overrides", "entities", "preferred"]
