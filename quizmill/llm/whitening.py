"""Whitening of embeddings by an exact integer scatter.

An entry c becomes the integer ``floor(64 * c) + 1000000``. Tasks subtract that shift, cut what is left into digits
of 20 bits and multiply digits by digits, so that a product of two blocks of rows is a sum of doubles below 2^53 and
exact; carries go on into as many digits as the sums need. Spark adds the digits up, the driver joins them to whole
numbers of any size: the number of vectors n, their sums S and cross-products. ``n * X'X - SS'`` is formed in whole numbers and
divided by n^2 only then, so neither the shift nor the number of rows costs precision, and
``eigh`` decomposes the result. What reaches the driver grows with the square of the dimensions and not with the rows.

The fit takes every different vector once. Copies are dropped in each task before the rest is dealt by the vectors' bytes.

Vectors that are null, or hold null, non-finite or too large entries (64 * c beyond 2^62 is no long), have no rows in the result. Vectors
of each length have a fit of their own; empty ones have no components. A component without variance (its eigenvalue lies within rounding
of the largest) has no rows, so a single vector, or copies of one, have none. Repeated rows are each returned, a null id stays null; an
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import shared

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bits of a digit, digits of a sum, and rows that are multiplied at once: 2^20 * 2^20 * 2^12 is below 2^53.
BITS, DIGITS, ROWS = 20, 10, 1 << 12
#: Entries of a block of vectors that is held as numbers.
ENTRIES = 1 << 20
MOST = 2.0**62


def quantised(batch: pa.RecordBatch):
    """For each block of rows: the indices of the rows that count, and their shifted integers by vector length."""
    vectors = batch.column(batch.schema.get_field_index("vector"))
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), size, 0)
    for length in np.unique(size[size > 0]).tolist():
        rows, each = np.flatnonzero(size == length), max(1, ENTRIES // length)
        for k in range(0, len(rows), each):
            some = rows[k : k + each]
            c = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), length)  # a null entry is NaN
            with np.errstate(over="ignore", invalid="ignore"):
                ok = (np.abs(c * SCALE) < MOST).all(1)
            yield some[ok], np.floor(c[ok] * SCALE).astype(np.int64)  # x without the shift


def packed(y: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes an entry, led by that number: equal vectors and no others have equal bytes."""
    top = np.maximum(y.max(1), ~y.min(1))  # of a negative number as many bits as of its complement
    width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(y)
    for w in (1, 2, 4, 8):
        at = np.flatnonzero(width == w)
        raw, step = y[at].astype(f"<i{w}").tobytes(), w * y.shape[1]
        for k, row in enumerate(at.tolist()):
            out[row] = bytes([w]) + raw[k * step : (k + 1) * step]
    return out


def _pack(batches):
    for batch in batches:
        for _, y in quantised(batch):
            yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(y), y.shape[1]), pa.int32()), "vector": pa.array(packed(y), pa.binary())})


def unpacked(batch: pa.RecordBatch):
    """The vectors of packed rows, in blocks of one length and width."""
    raw, ends = shared.rows_of(batch.column(1))
    size, length = np.diff(ends), batch.column(0).to_numpy().astype(np.int64)
    width = raw[ends[:-1]].astype(np.int64)
    kind = length * 16 + width
    for k in np.unique(kind).tolist():
        rows, w, n = np.flatnonzero(kind == k), k % 16, k // 16
        for a in range(0, len(rows), max(1, min(ROWS, ENTRIES // n))):
            some = rows[a : a + max(1, min(ROWS, ENTRIES // n))]
            at = ends[some][:, None] + np.arange(1, size[some[0]])
            yield np.frombuffer(raw[at].tobytes(), f"<i{w}").astype(np.int64).reshape(len(some), n)


def digits_of(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as digits of BITS bits, the least first; the last one has the sign."""
    out = []
    while len(y) and (int(y.max()) >= 1 << BITS or int(y.min()) < -(1 << BITS)):
        out.append((y & ((1 << BITS) - 1)).astype(np.float64))
        y = y >> BITS
    return [*out, y.astype(np.float64)]


def carried(total: np.ndarray) -> None:
    """Every digit but the last goes below 2^BITS; the rest goes on to the next."""
    for p in range(DIGITS - 1):
        total[p + 1] += total[p] >> BITS
        total[p] &= (1 << BITS) - 1


def products(y: np.ndarray, total: np.ndarray) -> None:
    """Add to the digits in ``total`` the cross-products of at most ROWS vectors, each with a one behind it: counts, sums and products at once."""
    parts = digits_of(np.hstack([y, np.ones((len(y), 1), np.int64)]))
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            total[a + b] += (left.T @ right).astype(np.int64)
    carried(total)


_DIGIT = [f"d{k}" for k in range(DIGITS)]


def _scatter(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for y in unpacked(batch):
            n = y.shape[1] + 1
            products(y, totals.setdefault(n - 1, np.zeros((DIGITS, n, n), np.int64)))
    for length, total in totals.items():
        i, j = np.triu_indices(length + 1)
        for a in range(0, len(i), ENTRIES):
            x, z = i[a : a + ENTRIES], j[a : a + ENTRIES]
            yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(x), length), pa.int32()), "i": pa.array(x, pa.int32()), "j": pa.array(z, pa.int32())} | {c: pa.array(total[k, x, z]) for k, c in enumerate(_DIGIT)})


class Fit(NamedTuple):
    """Of the vectors of one length: their number, shifted sums, unit eigenvectors as columns, eigenvalues, and shares of the variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def decomposed(n: int, sums: list[int], cross: np.ndarray, most: int) -> Fit:
    """cross: the whole cross-products as Python integers. The scatter is formed in whole numbers and each entry rounded once."""
    s = np.array(sums, dtype=object)
    scatter = n * cross - np.outer(s, s)
    over = n * n
    v = np.array([[int(x) / over for x in row] for row in scatter], np.float64)
    values, axes = np.linalg.eigh(v)
    trace = sum(int(x) for x in np.diagonal(scatter)) / over
    order = np.arange(len(values))[::-1][:most]
    order = order[values[order] > len(values) * np.finfo(np.float64).eps * max(float(values[-1]), 0.0)]
    values, axes = values[order], axes[:, order]
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(len(order))]) if len(order) else np.zeros(0)
    return Fit(n, [int(x) for x in sums], axes * sign, values, values / trace if trace else values)


def fitted(distinct: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each vector length, from the packed vectors."""
    schema = "length int, i int, j int, " + ", ".join(f"{c} long" for c in _DIGIT)
    total = distinct.mapInArrow(_scatter, schema).groupBy("length", "i", "j").agg(*(F.sum(c).alias(c) for c in _DIGIT))
    table = total.toArrow().to_pydict()
    sums: dict[int, dict[tuple[int, int], int]] = {}
    for length, i, j, *digits in zip(*(table[c] for c in ("length", "i", "j", *_DIGIT)), strict=True):
        sums.setdefault(length, {})[i, j] = reduce(lambda t, d: (t << BITS) + d, reversed(digits))
    fits = {}
    for length, entry in sums.items():
        cross = np.array([[entry[min(i, j), max(i, j)] for j in range(length)] for i in range(length)], dtype=object)
        fits[length] = decomposed(entry[length, length], [entry[i, length] for i in range(length)], cross, most)
    return fits


def centred(y: np.ndarray, fit: Fit) -> np.ndarray:
    """``n * x - S`` as whole numbers; the shift cancels."""
    bound = (int(np.abs(y).max()) + max(map(abs, fit.sums)) // fit.n + 1) * fit.n * 2 if len(y) else 0
    kind = np.int64 if bound < 1 << 62 else object
    return y.astype(kind) * fit.n - np.array(fit.sums, dtype=kind)


def deviations(d: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exact; null from 10^38 on."""
    if d.dtype != object and (not len(d) or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63):
        return pa.array((d * d).sum(1), pa.int64()).cast(pa.decimal128(38, 0), safe=False)
    d = d.astype(object)
    return pa.array([Decimal(x) if x < 10**38 else None for x in (d * d).sum(1).tolist()], pa.decimal128(38, 0))


def projected(d: np.ndarray, fit: Fit) -> np.ndarray:
    x = d.astype(np.float64) / fit.n if d.dtype != object else np.array([[int(c) / fit.n for c in row] for row in d], np.float64).reshape(d.shape)
    return x @ fit.axes / np.sqrt(fit.values)


def identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Of each length, the largest absolute entry of the covariance of the whitened vectors minus the identity, as measured over the fit list."""
    sent = distinct.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for y in unpacked(batch):
                fit = sent.value[y.shape[1]]
                if k := len(fit.values):
                    z = np.hstack([projected(centred(y, fit), fit), np.ones((len(y), 1))])
                    totals.setdefault(y.shape[1], np.zeros((k + 1, k + 1)))[:] += z.T @ z
        for length, total in totals.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(i), length), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array(total[i, j])})

    sums: dict[int, dict[tuple[int, int], float]] = {}
    for r in distinct.mapInArrow(run, "length int, i int, j int, total double").groupBy("length", "i", "j").agg(F.sum("total").alias("total")).collect():  # for each length the square of the components
        sums.setdefault(r.length, {})[r.i, r.j] = r.total
    out = {}
    for length, entry in sums.items():
        n, k = fits[length].n, len(fits[length].values)
        mean = [entry[i, k] / n for i in range(k)]
        out[length] = max(abs(entry[i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))
    return out


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row for each vector that counts and each of its first ``most`` components: the key as long, ``component`` from 1, ``n``,
    ``deviation`` (decimal, null from 10^38 on), ``whitened``, ``explained``, ``identity_error``."""
    spark = rows.sparkSession
    shared.shared_dir(spark)
    source = rows.select(shared.column(key).cast("long").alias("key"), shared.column(vector).cast("array<double>").alias("vector"))
    distinct = shared.stored(source.select("vector").mapInArrow(_pack, "length int, vector binary").distinct(), "vectors")
    fits = fitted(distinct, most)
    sent = spark.sparkContext.broadcast((fits, identity_errors(distinct, fits)))

    def run(batches):
        fits, errors = sent.value
        for batch in batches:
            for at, y in quantised(batch):
                fit = fits[y.shape[1]]
                k = len(fit.values)
                for a in range(0, len(y) if k else 0, ROWS):
                    d = centred(y[a : a + ROWS], fit)
                    every = pa.array(np.repeat(np.arange(len(d)), k))
                    wide = lambda x, n=len(d): pa.array(np.tile(x, n))
                    columns = [
                        batch.column(0).take(pa.array(at[a : a + ROWS])).take(every), wide(np.arange(1, k + 1, dtype=np.int32)), wide(np.array([fit.n] * k, np.int64)), deviations(d).take(every),
                        pa.array(projected(d, fit).ravel()), wide(fit.explained), wide(np.array([errors[y.shape[1]]] * k)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = source.mapInArrow(run, "key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
