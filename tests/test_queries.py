"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

from quizmill import plans
from quizmill.sources import tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in plans.SQL:
        want = duck.sql(plans.SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_purchases_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    """A task's share of the join and of the windows by session is bounded, whatever the session's number of partitions is."""
    monkeypatch.setattr(tables, "LINES", 500)
    df = plans.QUERIES["replayed_purchases"](spark, DATA)
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert df.rdd.getNumPartitions() == -(-n // 500) and df.count() == n
