"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from gradeloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), None)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        theirs = duck.execute(SQL[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)
    else:
        assert len(ours)


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
