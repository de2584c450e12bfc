"""Every query with SQL, on the smallest tables, against DuckDB."""

import math
import os

import duckdb
import pytest

from motifold.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    own = duckdb.connect()
    own.execute("SET TimeZone='UTC'")
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return own


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
            return "nan" if math.isnan(x) else repr(round(float(x), 9) + 0.0)
        return str(x)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    told = sql.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in told.description], told.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
