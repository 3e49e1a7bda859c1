"""Whitening against whole numbers and fractions that share nothing with the operator."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quizmill.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def vectors(seed, rows, d, spread=1.0):
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(d, d)) * spread
    return (rng.normal(size=(rows, d)) @ axes).astype(np.float32).tolist()


def plain(rows, most=16):
    """By fractions: for each vector length the distinct shifted vectors, n, S and the exact covariance."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(64 * float(c)) < 2.0**62 for c in v)]
    fits = {}
    for d in {len(x) for _, x in kept}:
        fit = sorted({tuple(x) for _, x in kept if len(x) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = [[Fraction(n * a - b, n) for a, b in zip(x, s, strict=True)] for x in fit]
        v = [[sum(r[i] * r[j] for r in centred) / n for j in range(d)] for i in range(d)]
        fits[d] = (n, s, v)
    return kept, fits


def check(got, rows):
    kept, fits = plain(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    found = 0
    for d, (n, s, v) in fits.items():
        exact = np.array([[float(x) for x in row] for row in v])
        values, axes = np.linalg.eigh(exact)
        trace = float(sum(v[i][i] for i in range(d)))
        count = min(16, int((values > d * np.finfo(float).eps * values[-1]).sum()))
        white = {}
        for i, x in kept:
            if len(x) != d:
                continue
            own = sorted(by.get(i, []), key=lambda r: r.component)
            assert [r.component for r in own] == list(range(1, count + 1))
            found += len(own)
            deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            centred = [float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)]
            for r in own:
                assert r.n == n and int(r.deviation) == deviation
                e = values[-r.component]
                assert r.explained == pytest.approx(e / trace, rel=1e-9)
                assert abs(r.whitened) == pytest.approx(abs(float(np.dot(centred, axes[:, -r.component])) / math.sqrt(e)), rel=1e-6, abs=1e-9)
                assert r.identity_error <= 1e-4
            white[tuple(x)] = [r.whitened for r in own]
        if count:
            z = np.array(list(white.values()))
            z = z - z.mean(0)
            assert np.abs(z.T @ z / n - np.eye(count)).max() < 1e-6
            assert len({r.identity_error for i, x in kept if len(x) == d for r in by[i]}) == 1
    assert found == len(got)


def table(rows):
    return [(i, v, 0, "x", "y") for i, v in rows]


def test_op12(spark, write_table):
    good = vectors(1, 120, 20, 0.3)
    nan, inf = float("nan"), float("inf")
    rows = list(enumerate(good))
    rows += [(200 + k, good[3]) for k in range(60)]  # copies of one vector, which count once
    rows += [(300, None), (301, [None, *good[0][1:]]), (302, [nan, *good[0][1:]]), (303, [*good[0][1:], inf]), (304, []), (305, [3e38] * 20)]
    folder = write_table("embeddings", table(rows), SCHEMA)
    check(queries.op12_embedding_whitening(spark, folder).collect(), rows)


def test_lengths_without_variance_and_repeats(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, -4.0]), (3, [7.0, 1.0]), (4, [0.1, 0.2, 0.3]), (5, [0.1, 0.2, 0.3]), (6, [1.0]), (7, [2.0]), (8, [9.0, 9.0, 9.0, 9.0])]
    got = whitening.whitened(spark.createDataFrame(table(rows), SCHEMA)).collect()
    check(got, rows)
    assert {r.vec_id for r in got} == {1, 2, 3, 6, 7}  # three equal entries, and one vector alone, have no variance
    twice = spark.createDataFrame(table([(1, [0.5]), (1, [0.5]), (None, [1.5])]), SCHEMA)
    assert sorted(((r.vec_id, r.n, r.component) for r in whitening.whitened(twice).collect()), key=repr) == [(1, 2, 1), (1, 2, 1), (None, 2, 1)]


def test_empty(spark, write_table):
    assert queries.op12_embedding_whitening(spark, write_table("embeddings", [], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame(table([(1, None), (2, [])]), SCHEMA)).collect() == []


@pytest.mark.parametrize("top", [100, 30_000, 2**40, 2**61])
def test_products_are_exact(top):
    """Numbers of every size, several blocks: digits give the same sums as Python's integers."""
    rng = np.random.default_rng(top % 1000)
    y = rng.integers(-top, top, (700, 4))
    total = np.zeros((whitening.DIGITS, 5, 5), np.int64)
    for k in range(0, 700, 150):
        whitening.products(y[k : k + 150], total)
    x = [[*map(int, row), 1] for row in y]
    for i in range(5):
        for j in range(5):
            assert sum(int(total[p, i, j]) << whitening.BITS * p for p in range(whitening.DIGITS)) == sum(r[i] * r[j] for r in x)


def test_large_entries_are_exact(spark):
    """Sums of squares beyond 64 bits: no float could hold them."""
    rows = [(k, [float(2.0**50 + 64 * k * k), float(-(2.0**40) * k), 0.25 * k]) for k in range(9)]
    schema = SCHEMA.replace("float", "double")
    got = whitening.whitened(spark.createDataFrame(table(rows), schema)).collect()
    kept, fits = plain(rows)
    n, s, _ = fits[3]
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in kept}
    assert max(want.values()) > 2**64 and {r.vec_id: int(r.deviation) for r in got} == want


def test_packed_bytes():
    y = np.array([[0, 127], [0, 128], [-128, 0], [-129, 0], [2**31, 0], [-(2**31), 1]])
    assert [b[0] for b in whitening.packed(y)] == [1, 2, 1, 2, 8, 4]
    assert len(set(whitening.packed(y))) == len(y)
