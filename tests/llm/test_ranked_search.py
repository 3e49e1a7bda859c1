"""Ranked search against plain loops over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import SCHEMA, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizmill.llm import oracle, queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id string, rank int"


def plain(docs, items, k=20):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    total, count = sum(n for *_, n in bags), len(bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        found = []
        for i, c, n in bags:
            m = 100 - 25 + (25 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is not None, i, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(found[:k])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def items():
    texts = [None, "", " .,- ", "river stone green", "RIVER river river", "é漢字😀 ñandú", "password hunter2hunter2", "nosuchword", prose(3, 30), prose(10, 40), "x" * 5000, "same line here", "edit1 edit2 edit4"]
    rows = [(i, t, "a", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "green stone", "a", 1)]


@pytest.fixture(params=[1 << 22, 3000], ids=["one shard", "many shards"])
def sized(request, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD", request.param)


def test_op13(spark, write_table, sized):
    folder = write_table("documents", documents(), SCHEMA)
    spark.createDataFrame(items(), ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    got = queries.op13_ranked_search(spark, folder).select("item_id", "rank", "doc_id", "score").collect()
    assert ordered(map(tuple, got)) == ordered(plain([r[:2] for r in documents()], [r[:2] for r in items()]))


def test_blocks_of_queries(spark, write_table, monkeypatch):
    docs = spark.createDataFrame(documents(), SCHEMA)
    asked = spark.createDataFrame(items(), ITEMS)
    parts = list(ranked_search.blocks(asked, "item_id", 2000))
    assert len(parts) > 1 and ordered(x for p in parts for x in p) == ordered((i, t or "") for i, t, *_ in items())
    monkeypatch.setattr(ranked_search.blocks, "__defaults__", (2000,))
    got = ranked_search.search(ranked_search.index(docs), asked).collect()
    assert ordered(map(tuple, got)) == ordered(plain([r[:2] for r in documents()], [r[:2] for r in items()]))


def test_ties_by_id_beyond_k(spark):
    """Many equal documents over many tasks: the least ids win, each once a row."""
    docs = spark.createDataFrame([(i // 2, "green river" if i % 3 else "other words") for i in range(300)], "doc_id long, text string").repartition(16)
    asked = spark.createDataFrame([(5, "river")], "item_id long, text string")
    got = ranked_search.search(ranked_search.index(docs), asked).collect()
    assert ordered(map(tuple, got)) == ordered(plain([(i // 2, "green river" if i % 3 else "other words") for i in range(300)], [(5, "river")]))


def test_empty(spark, write_table):
    folder = write_table("documents", [], SCHEMA)
    spark.createDataFrame(items(), ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    assert queries.op13_ranked_search(spark, folder).collect() == []
    docs = spark.createDataFrame(documents(), SCHEMA)
    assert ranked_search.search(ranked_search.index(docs), spark.createDataFrame([], ITEMS)).collect() == []
    assert "op13_ranked_search" in oracle.ORACLE_SQL


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abAB09 .-é漢\n😀\x00{", max_size=12), min_size=1, max_size=6))
def test_terms(texts):
    raw = [t.encode() for t in texts]
    buf = ranked_search.folded(np.frombuffer(b"".join(raw), np.uint8))
    starts, stops, own = ranked_search.terms(buf, np.cumsum([0, *map(len, raw)]))
    got = [(k, buf[a:b].tobytes().decode()) for a, b, k in zip(starts, stops, own, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in TERM.findall(t.translate(LOWER))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-3, 3), st.booleans()), max_size=40), st.integers(1, 10))
def test_best(rows, k):
    scores, ids, known = (np.array([r[c] for r in rows], t) for c, t in enumerate((np.int64, np.int64, bool)))
    got = [(int(scores[j]), bool(known[j]), int(ids[j])) for j in ranked_search.best(scores, ids, known, k)]
    want = sorted(((s, n, i) for s, i, n in rows if s > 0), key=lambda x: (-x[0], x[1], x[2]))[:k]
    assert got == want


def test_row_groups_hold_few_shards(spark):
    """One task makes many shards; what a reader or writer holds at once does not grow with their number."""
    words = F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda k: F.hex(F.xxhash64(k, "doc_id")))
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text")).coalesce(1)
    corpus = ranked_search.index(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in corpus.shards.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == 10 and max(groups) <= 2
