"""Numbering and carried headings over partitions: no task that holds a whole table or file."""

import random

import pytest
from pyspark.sql import functions as F

from quizmill.operators import bank
from quizmill.sources import documents


def test_places_over_a_million_rows(spark):
    rows = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    got = bank.placed(rows, "place", "k")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    s = got.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()
    assert tuple(s) == (1, 1_000_000, 1_000_000)
    # in order: between neighbours by place the key grows
    order = got.select((F.col("place") - 1).alias("p"), F.col("k").alias("next")).join(got, F.col("p") == F.col("place"))
    assert order.where("next <= k").count() == 0


def test_numbered_ids(spark):
    new = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1)], "term string, at int")
    old = spark.createDataFrame([("q007",), ("q5",), (None,)], "id string")
    assert {r.new_id: (r.term, r["at"]) for r in bank.numbered(new, old, "q", "term", "at").collect()} == {"q008": ("a", 9), "q009": ("b", 1), "q010": ("b", 2)}
    assert bank.numbered(new.where("at > 99"), old, "q", "term", "at").collect() == []
    assert sorted(r.new_id for r in bank.numbered(new, old.where("id = ''"), "q", "term", "at").collect()) == ["q001", "q002", "q003"]


def whole(seed, parts):
    r = random.Random(seed)
    out = ["# Bank", "intro"]
    for k in range(parts):
        sign = r.choice("ABCDE")
        out.append(f"{'#' * r.choice([2, 3])} {sign}. Part {k}" + r.choice(["", " (3)"]))
        for n in range(r.randint(0, 4)):
            out.append(f"{n}. **Term {k} {n}** — Means {r.randint(0, 99)}.")
        for n in range(r.randint(0, 3)):
            out += [f"**{sign}{k * 10 + n}.** What is", f"{k}? A. One B. Two C. Three", f"D. Four **Answer: {r.choice('ABCD')}.** Because", f"of {n}.", "", r.choice(["A note.", ""])]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("size", [64, 1000])
def test_a_file_cut_anywhere_gives_the_same(spark, tmp_path, size):
    """One file as a single split, and as hundreds of splits of some lines or less."""
    for k in range(2):
        (tmp_path / f"f{k}.md").write_text(whole(k, 30))
    keep = lambda rows, *drop: sorted(map(str, rows.drop("split", "at", *drop).collect()))
    terms, scenarios = documents.trading(spark, str(tmp_path / "*.md"))
    one = keep(terms), keep(scenarios)
    assert len(one[0]) > 50 and len(one[1]) > 30
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        splits = documents.lines(spark, str(tmp_path / "*.md")).select("file", "split").distinct().count()
        terms, scenarios = documents.trading(spark, str(tmp_path / "*.md"))
        many = keep(terms), keep(scenarios)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert splits > 2000 / size * 2 and many == one


def test_carried_values(spark):
    """A value holds through splits that have none, and not into the next file."""
    rows = spark.createDataFrame([("f", s, a, v) for s, a, v in [(0, 1, None), (0, 2, "x"), (10, 1, None), (20, 5, None), (20, 6, "y"), (20, 7, None), (30, 1, None)]] + [("g", 0, 1, None)], "file string, split long, at long, v string")
    got = {(r.file, r.split, r["at"]): r.last for r in documents.carried(rows, last=F.col("v")).collect()}
    assert got == {("f", 0, 1): None, ("f", 0, 2): "x", ("f", 10, 1): "x", ("f", 20, 5): "x", ("f", 20, 6): "y", ("f", 20, 7): "y", ("f", 30, 1): "y", ("g", 0, 1): None}
