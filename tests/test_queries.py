"""Every core query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from pagequern.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(rows):
    return sorted(repr([round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    sql = Q.oracle_sql().get(name)
    if sql is None:  # no SQL states the result: it has rows, and the same ones each time
        again = Q.queries()[name](spark, DATA).select(*cols).collect()
        assert rows and plain(rows) == plain(again)
        return
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    assert plain(rows) == plain(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_plans_do_not_depend_on_the_size_of_an_input(spark):
    """Without the setting no input is dealt out, however few its splits; with it every one is."""
    from pagequern.sources import tables

    small, large = spark.range(3).repartition(1), spark.range(100_000).repartition(64)
    assert all(tables.spread(x) is x for x in (small, large))
    spark.conf.set(tables.DEAL, "5")
    try:
        assert all(tables.spread(x).rdd.getNumPartitions() == 5 for x in (small, large))
    finally:
        spark.conf.unset(tables.DEAL)


def test_filters_reach_the_scan(spark):
    plan = Q.queries()["image_best"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag,img)" in plan
