"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pandas as pd
import pytest

from meshquill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
HEAVY = {"symmetry_fitted", "random_forest", "gbt", "cross_validation", "permutation_importance", "feature_table_fitted"}


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, decimal.Decimal) or hasattr(x, "dtype") and x.dtype.kind == "f":
        return float(x)
    x = x.item() if hasattr(x, "item") else x
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x  # pandas turns integers with gaps into doubles


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([cell(x) for x in r]) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HEAVY))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
