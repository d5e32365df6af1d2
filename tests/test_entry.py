"""The driver's contract: the queries equal their SQL on the small tables."""

import math
import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def rows(frame):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, float) else int(x) if hasattr(x, "dtype") and x.dtype.kind in "iu" else x

    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def names():
    from packlake.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from packlake.plans import catalog

    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
