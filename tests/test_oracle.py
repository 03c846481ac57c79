"""Every registered query against its DuckDB oracle on the smallest test tables."""

import pytest

from inputs import SMOKE
from oracle_check import duck, rows_of

import __spark_entry__ as entry
from affinity.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SMOKE)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cur.fetchall(), cols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "recommended_package" in df.columns
