"""Every registered query of the language against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in columns) for r in df.collect()), key=str)
    q = duck.sql(catalogue.oracle_sql()[name])
    at = [[d[0] for d in q.description].index(c) for c in columns]
    assert got == sorted((tuple(_cell(r[i]) for i in at) for r in q.fetchall()), key=str)


def test_entry_imports_without_the_pipeline():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
