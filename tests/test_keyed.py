"""Keyed tables against a dictionary that takes the same writes one after the other; crashes, races, replays, pruning."""

import random

import pytest
from pyspark.sql import functions as F

from quizmill.sources import keyed, places
from quizmill.sources.keyed import KeyedTable

SCHEMA = "k long, a string, b string, c int, d int, at long"
POLICIES = {"a": "last", "b": "first", "c": "last_known", "d": "first_known"}


def rows_of(spark, rows, columns="k, a, b, c, d, at"):
    fields = [f for f in SCHEMA.split(", ") if f.split()[0] in columns.split(", ")]
    return spark.createDataFrame(rows, ", ".join(fields))


def plain(writes):
    """(rows by key) after writes of (rows, insert), each row (k, a, b, c, d, at) with a distinct at."""
    every = sorted(((at, k, v) for rows, _ in writes for k, *v, at in rows), key=lambda x: x[0])
    inserted = {k for rows, insert in writes if insert for k, *_ in rows}
    out = {}
    for _, k, (a, b, c, d) in every:
        if k in inserted:
            old = out.get(k)
            out[k] = (a, b, c, d) if old is None else (a, old[1], old[2] if c is None else c, old[3] if old[3] is not None else d)
    return out


def content(table):
    return {r.k: (r.a, r.b, r.c, r.d) for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["k"], POLICIES, SCHEMA, ["at"], buckets=4, keep=2)


def some(seed, n=40):
    r = random.Random(seed)
    # keys with a null among them, values with nulls; ``at`` tells all rows of all seeds apart
    return [(r.choice([None, *range(12)]), r.choice([None, "x", "y"]), r.choice([None, "p", "q"]), r.choice([None, 1, 2]), r.choice([None, 3, 4]), r.randint(0, 10**6) * 10 + seed) for _ in range(n)]


def test_writes_replays_and_compaction(spark, table):
    assert table.read().collect() == [] and not table.compact()
    writes = [(some(s), s % 2 == 0) for s in range(6)]
    for s, (rows, insert) in enumerate(writes):
        assert table.write(rows_of(spark, rows), "w", s, insert)
        assert not table.write(rows_of(spark, rows), "w", s, insert)  # a replay
        assert content(table) == plain(writes[: s + 1])
        if s in (2, 4):
            assert table.compact() and len(table.manifest()["folders"]) == 1
            assert content(table) == plain(writes[: s + 1])
    assert table.write(rows_of(spark, []), "w", 6) and content(table) == plain(writes)
    assert table.vacuum() > 0 and content(table) == plain(writes)
    again = KeyedTable(spark, table.path, ["k"], POLICIES, SCHEMA, ["at"], buckets=4)  # another session's view
    assert content(again) == plain(writes)


def test_a_crash_between_delta_and_pointer_loses_nothing(spark, table, monkeypatch):
    first, second = some(1), some(2)
    table.write(rows_of(spark, first), "w", 0)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(places, "put_once", crash)
        with pytest.raises(RuntimeError):
            table.write(rows_of(spark, second), "w", 1)
    assert len(places.names(spark, f"{table.path}/data")) == 2  # the orphan is there, and no reader sees it
    assert content(table) == plain([(first, True)])
    assert table.write(rows_of(spark, second), "w", 1)
    assert content(table) == plain([(first, True), (second, True)])


def test_writers_that_meet_keep_both(spark, table, monkeypatch):
    """Another writer, and a compaction, commit while this one has read the manifest and not yet committed."""
    first, second, third = some(1), some(2), some(3)
    table.write(rows_of(spark, first), "w", 0)
    other = KeyedTable(spark, table.path, ["k"], POLICIES, SCHEMA, ["at"], buckets=4)
    real, met = places.put_once, []

    def late(*args):
        if not met:
            met.append(1)
            monkeypatch.setattr(places, "put_once", real)
            assert other.write(rows_of(spark, second), "other", 0) and other.compact()
        return real(*args)

    monkeypatch.setattr(places, "put_once", late)
    assert table.write(rows_of(spark, third), "w", 1)
    assert met and content(table) == plain([(first, True), (second, True), (third, True)])


def test_a_compaction_keeps_what_comes_meanwhile(spark, table, monkeypatch):
    rows = [some(s) for s in range(3)]
    table.write(rows_of(spark, rows[0]), "w", 0)
    table.write(rows_of(spark, rows[1]), "w", 1)
    store = table._store

    def slow(entries):
        name = store(entries)
        monkeypatch.setattr(table, "_store", store)
        table.write(rows_of(spark, rows[2]), "w", 2)
        return name

    monkeypatch.setattr(table, "_store", slow)
    assert table.compact() and len(table.manifest()["folders"]) == 2
    assert content(table) == plain([(r, True) for r in rows])


def test_columns_that_are_not_written_stay_and_updates_make_no_rows(spark, table):
    table.write(rows_of(spark, [(1, "x", "p", 1, 3, 5)]), "w", 0)
    table.write(rows_of(spark, [(1, "z", 9), (2, "z", 9)], "k, a, at"), "u", 0, insert=False)
    assert content(table) == {1: ("z", "p", 1, 3)}


def test_without_order_the_last_commit_wins(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], {"a": "last", "b": "first"}, "k long, a string, b string")
    for n, value in enumerate(["m", "z", "c"]):
        table.write(spark.createDataFrame([(1, value, value)], "k long, a string, b string"), "w", n)
        if n == 1:
            table.compact()
    assert [tuple(r) for r in table.read().collect()] == [(1, "c", "m")]


def test_a_lookup_reads_one_bucket(spark, table):
    rows = some(5, 200)
    table.write(rows_of(spark, rows), "w", 0)
    want = plain([(rows, True)])
    for k in (3, None):
        found = table.read({"k": k})
        assert [(r.a, r.b, r.c, r.d) for r in found.collect()] == [want[k]]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_bucket" in plan
    assert table.read({"k": 999}).collect() == []


def test_one_hot_key(spark, table):
    """Half of all rows have one key: each task merges its own before the rest is dealt."""
    hot = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").alias("a"), F.lit("p").alias("b"), F.lit(1).alias("c"), F.lit(2).alias("d"), F.col("id").alias("at"))
    table.write(hot, "w", 0)
    assert table.read({"k": 7}).first().a == "19998" and table.read().count() == 10_000 + (0 if 7 % 2 else 1)


def test_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/x/1.json"
    assert places.put_once(spark, path, "é") and not places.put_once(spark, path, "b")
    assert places.text(spark, path) == "é" and places.names(spark, f"file://{tmp_path}/x") == [".1.json.crc", "1.json"] or places.names(spark, f"file://{tmp_path}/x") == ["1.json"]
    assert keyed.EMPTY["number"] == 0


def test_a_write_shuffles_once(spark, table):
    """Rows are merged in the task that writes their bucket."""
    dealt = table._dealt(spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("a")))
    plan = dealt.groupBy("_bucket", "_part", "k").agg(F.min("a"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
