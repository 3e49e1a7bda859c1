"""Benchmark decontamination against Smith-Waterman over all pairs of items and documents."""

import random

import numpy as np
import pytest
from cases import prose

from quizmill.llm import decontaminate

LIMIT = 0.4


def whole(item, text):
    """The share of its own score that an item reaches by local alignment in the whole text; plain loops over the matrix."""
    a, b = item.lower().split(), text.lower().split()
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(a))


def edited(words, kind, share, r):
    out = []
    for k, w in enumerate(words):
        hit = r.random() < share if kind != "even" else k % round(1 / share) == round(1 / share) - 1
        if not hit:
            out.append(w)
        elif kind == "gaps":
            out += r.choice([[], [w, f"new{r.random()}"]])
        else:
            out.append(f"new{r.random()}")
    return out


@pytest.mark.parametrize(("kind", "share", "recall"), [("random", 0.1, 1.0), ("random", 0.2, 1.0), ("random", 0.3, 0.95), ("even", 1 / 4, 1.0), ("even", 1 / 3, 1.0), ("even", 1 / 5, 1.0), ("gaps", 0.15, 0.95)])
def test_recall_against_all_pairs(spark, kind, share, recall):
    r = random.Random(8)
    items = [(k, prose(4000 + k, 30)) for k in range(40)]
    rows = []
    for k, t in items:
        rows.append((k, f"{prose(5000 + k, r.randint(0, 40))} {' '.join(edited(t.split(), kind, share, r))} {prose(6000 + k, 20)}".strip()))
    rows += [(100 + k, prose(7000 + k, 60)) for k in range(10)]
    got = {(d.doc_id, h.item_id): h.score for d in decontaminate.matched(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() for h in d.benchmark_hits}
    want = {(d, i): s for d, text in rows for i, item in items if (s := whole(item, text)) >= LIMIT}
    assert set(got) <= set(want) and len(want) >= 30
    assert len(got) >= recall * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_short_items_and_long_texts(spark):
    items = [(1, "harbor"), (2, "two short words only here ok now"), (3, prose(80, 2000)), (4, prose(81, 8))]
    long = " ".join(prose(90 + k, 2000) for k in range(40))
    rows = [(1, "the harbor and the harbor again"), (2, f"so {items[1][1]} they are"), (3, f"{long} {items[2][1]} {long}"), (4, f"x {items[3][1]} y"), (5, long), (6, "")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda least: {d.doc_id: [(h.item_id, h.first_word, h.end_word) for h in d.benchmark_hits] for d in decontaminate.matched(docs, asked, least_words=least).collect()}
    at = len(long.split())
    assert found(8) == {1: [], 2: [], 3: [(3, at, at + 2000)], 4: [(4, 1, 9)], 5: [], 6: []}
    assert found(2) == {1: [], 2: [(2, 1, 8)], 3: [(3, at, at + 2000)], 4: [(4, 1, 9)], 5: [], 6: []}
    word = long.split().index("harbor")
    assert found(1) == {1: [(1, 1, 2)], 2: [(2, 1, 8)], 3: [(3, at, at + 2000), (1, word, word + 1)], 4: [(4, 1, 9)], 5: [(1, word, word + 1)], 6: []}


def test_short_items_against_all_windows(spark):
    """Every item of one to seven words, repeated ones too, in every document that has its words in a row, at the first place."""
    r = random.Random(3)
    items = [(k, " ".join(r.choice("ab Cd").strip() or "b" for _ in range(r.randint(0, 7)))) for k in range(60)] + [(60, "a b"), (61, "A  B"), (62, None)]
    rows = [(k, "\n".join(r.choice(["a", "B", "c", "d"]) for _ in range(r.randint(0, 9)))) for k in range(50)] + [(50, None)]
    got = {(d.doc_id, h.item_id): (h.score, h.first_word, h.end_word) for d in decontaminate.matched(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() for h in d.benchmark_hits}
    want = {}
    for d, t in rows:
        have = (t or "").lower().split()
        for i, item in items:
            asked = (item or "").lower().split()
            where = [k for k in range(len(have) - len(asked) + 1) if have[k : k + len(asked)] == asked]
            if asked and where:
                want[d, i] = (1.0, where[0], where[0] + len(asked))
    assert len(want) > 50 and got == want


def test_alignment_begins_where_it_should():
    rng = np.random.default_rng(6)
    for _ in range(300):
        item, text = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 30))
        score, a, b = decontaminate.align(item, text)
        join = lambda x: " ".join(map(str, x))
        assert score == round(whole(join(item), join(text)) * 2 * len(item))
        if score:
            assert round(whole(join(item), join(text[a:b])) * 2 * len(item)) == score and text[a] in item and text[b - 1] in item
