"""Katz backoff of several orders against plain counting."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, documents, prose
from pyspark.sql import functions as F

from quizmill.llm import katz, katz_orders

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def shares(times):
    """What an n-gram seen 1 to 5 times keeps of its count, from the counts of counts; written from the formula alone."""
    n = [sum(c == r for c in times.values()) for r in range(1, 7)]
    if all(n[:5]):
        k = 6 * n[5] / n[0]
        if k != 1:
            d = [((r + 1) * n[r] / n[r - 1] / r - k) / (1 - k) for r in range(1, 6)]
            if all(0 < x < 1 for x in d):
                return d
    return [(r - 0.5) / r for r in range(1, 6)]


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts, order):
        self.times = [Counter() for _ in range(order)]
        for t in texts:
            padded = ["^"] * (order - 1) + t
            for i in range(order - 1, len(padded)):
                for k in range(order):
                    self.times[k][tuple(padded[i - k : i + 1])] += 1
        self.share = [shares(c) for c in self.times]
        self.all = [Counter() for _ in range(order)]
        self.after = [defaultdict(list) for _ in range(order)]
        for k in range(order):
            for g, c in self.times[k].items():
                self.all[k][g[:-1]] += c
                self.after[k][g[:-1]].append(g[-1])
        self.unknown = 1 - sum(self.seen(g) for g in self.times[0])

    def seen(self, g):
        k, c = len(g) - 1, self.times[len(g) - 1][g]
        return (c * self.share[k][c - 1] if c <= 5 else c - 0.5) / self.all[k][g[:-1]]

    def p(self, g):
        if self.times[len(g) - 1][g]:
            return self.seen(g)
        if len(g) == 1:
            return self.unknown
        h = g[:-1]
        if not self.all[len(g) - 1][h]:
            return self.p(g[1:])
        own = self.after[len(g) - 1][h]
        a = (1 - sum(self.seen((*h, w)) for w in own)) / (1 - sum(self.seen((*h[1:], w)) for w in own))
        return a * self.p(g[1:])


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def test_discounts():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = np.sort(r.integers(0, 4000, 6))[::-1].copy()
        times = {(k, i): k + 1 for k, m in enumerate(n) for i in range(m)}
        assert np.allclose(katz.discounts(n), shares(times))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(spark, write_table, order):
    table = documents() + [(2000 + k, prose(k % 9, 60), "en", "s", 1, "x") for k in range(60)]
    docs = spark.read.parquet(write_table("documents", table, SCHEMA) + "/documents.parquet")
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in table]
    plain = Plain([tokens(r[1]) for r, h in zip(table, held, strict=True) if not h], order)
    words = [g[0] for g in plain.times[0]]
    for h in [g[:-1] for g in list(plain.times[order - 1])[:: max(1, len(plain.times[order - 1]) // 5)]]:  # probabilities after a history sum to one
        nothing = plain.p((*h, "no such word"))
        assert math.isclose(sum(plain.p((*h, w)) for w in words) + nothing, 1.0, abs_tol=1e-9)
    want = []
    for r, x in zip(table, held, strict=True):
        t = ["^"] * (order - 1) + tokens(r[1])
        want.append((r[0], x, len(t) - order + 1, sum(math.log10(plain.p(tuple(t[i - order + 1 : i + 1]))) for i in range(order - 1, len(t)))))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.score) for r in katz_orders.scores(docs, held_out(), order).collect()]
    by = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-6)
    if order == 2:
        fast = [(r.doc_id, r.held_out, r.n_tokens, r.score) for r in katz.scores(docs, held_out()).collect()]
        for g, w in zip(sorted(got, key=by), sorted(fast, key=by), strict=True):
            assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-6)


def test_order_three_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz_orders.scores(none, held_out()).collect() == []
    only_held = spark.createDataFrame([(k, "a b") for k in range(60)], "doc_id long, text string").where(held_out())
    assert {r.score for r in katz_orders.scores(only_held, held_out()).collect()} == {0.0}
