"""Every core query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from weftspark.plans import registry

DIR = os.environ.get("WEFTSPARK_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def norm(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(("%.9g" % x if isinstance(x, float) else str(x)) if not pd.api.types.is_scalar(x) or not pd.isna(x) else None for x in r) for r in pdf[cols].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, duck, name):
    assert norm(registry.QUERIES[name](spark, DIR).toPandas()) == norm(duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
