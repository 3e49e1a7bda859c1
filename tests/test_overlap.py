"""Word overlap by rare words against all pairs; banks of which only some files are opened."""

import random

import pytest
from pyspark.sql import functions as F

from quizmill import plans
from quizmill.operators import checks
from quizmill.sources import documents


@pytest.mark.parametrize("least", [0.2, 0.6, 0.9, 1.0])
def test_all_pairs_of_the_share_are_found(spark, least):
    r = random.Random(int(least * 10))
    words = [f"w{int(r.paretovariate(0.7)) % 40}" for _ in range(4000)]
    some = lambda n: sorted({r.choice(words) for _ in range(n)})
    texts = [(k, some(r.randint(0, 25))) for k in range(120)]
    items = [(k, some(r.randint(0, 12))) for k in range(60)] + [(99, texts[5][1]), (98, [])]
    got = checks.overlapping(spark.createDataFrame(texts, "text int, words array<string>"), spark.createDataFrame(items, "item int, words array<string>"), least)
    want = {(i, t): len(set(a) & set(b)) / len(a) for i, a in items for t, b in texts if a and len(set(a) & set(b)) / len(a) >= least}
    assert len(want) > 3 and {(x.item, x.text): x.share for x in got.collect()} == pytest.approx(want)


def test_a_common_word_joins_nothing_alone(spark):
    """A word of every text is in every item: pairs meet by rarer words only."""
    texts = spark.range(2000).select(F.col("id").alias("text"), F.array(F.lit("the"), F.concat(F.lit("a"), F.col("id").cast("string")), F.concat(F.lit("b"), F.col("id").cast("string"))).alias("words"))
    items = texts.select((-F.col("text")).alias("item"), "words")
    got = checks.overlapping(texts, items, 0.6)
    assert got.count() == 2000 and got.where("share < 1").count() == 0


def test_pairs_that_share_one_word_are_found(spark):
    """A pair meets however small its share is, in the operator and in the query."""
    r = random.Random(5)
    some = lambda n: sorted({f"w{r.randint(0, 60)}" for _ in range(n)})
    texts, items = [(k, some(r.randint(0, 20))) for k in range(60)], [(k, some(r.randint(0, 12))) for k in range(30)]
    got = checks.meeting(spark.createDataFrame(texts, "text int, words array<string>"), spark.createDataFrame(items, "item int, words array<string>"))
    want = {(i, t): len(set(a) & set(b)) / len(a) for i, a in items for t, b in texts if set(a) & set(b)}
    assert min(want.values()) < 0.2 and {(x.item, x.text): x.share for x in got.collect()} == pytest.approx(want)
    assert "HAVING" not in plans.SQL["word_overlap"]


def test_only_the_asked_files_are_opened(spark, tmp_path):
    path = str(tmp_path / "banks")
    documents.write_banks(spark.range(30).select(F.concat(F.lit("s"), F.col("id") % 5).alias("slug"), F.concat(F.lit("q"), "id").alias("id"), F.col("id").cast("int").alias("answer")), path)
    found = documents.bank_of(spark, path, ["s1", "s3", "absent"])
    assert sorted((x.slug, len(x.questions)) for x in found.collect()) == [("s1", 6), ("s3", 6)]
    assert "PartitionFilters: [file" in found._jdf.queryExecution().executedPlan().toString()
    for f in (tmp_path / "banks" / "file=s2").iterdir():
        f.unlink()  # a file that goes missing is not noticed, since it is not read
    assert documents.bank_of(spark, path, ["s1"]).count() == 1
