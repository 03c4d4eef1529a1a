"""The driver contract, and every query against its SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from tidemark.plans import queries as plans

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row)


def same(spark, views, query, sql):
    frame = query(spark, SF)
    columns = sorted(frame.columns)
    found = sorted((plain(r) for r in frame.select(*columns).collect()), key=repr)
    answer = views.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    rows = answer.fetchall()
    assert found == sorted((plain(tuple(r[names.index(c)] for c in columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, views, name):
    same(spark, views, plans.QUERIES[name], plans.ORACLES[name])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["key", "value", "lo", "hi"]


def test_self_join_is_stable(spark, views):
    """The same rows as the SQL, again and again, whatever the partitions: exact multisets."""
    import collections

    want = collections.Counter(views.execute(f"select key, value, lo, hi from ({plans.ORACLES['self_joined']}) x").fetchall())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = plans.QUERIES["self_joined"](spark, SF).select("key", "value", "lo", "hi")
            assert collections.Counter(map(tuple, found.collect())) == want
            assert collections.Counter(views.execute(f"select key, value, lo, hi from ({plans.ORACLES['self_joined']}) x").fetchall()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_joins_deal_by_time(spark):
    """No join of the engine is a nested loop, and the temporal joins meet on bins of time."""
    for name in ("joined_to", "self_joined", "find_interval_set", "fill_gaps_with"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "_bin" in plan, name
