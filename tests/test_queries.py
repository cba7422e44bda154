import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import outside, workbench

# One registry; both modules add to it.
assert outside.QUERIES is workbench.QUERIES
QUERIES, ORACLE_SQL = outside.QUERIES, outside.ORACLE_SQL
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
            return repr(round(float(v), 6))
        return str(v)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
