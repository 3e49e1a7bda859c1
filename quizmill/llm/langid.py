"""The language of texts by error-correcting output codes.

Every language has a codeword of signs. For each bit of the codewords a linear classifier over n-grams of letters says on
which side of the bit a text lies: a naive Bayes ratio of the languages with a plus to those with a minus, each language counting
alike however many texts it has. Decoding takes the language whose codeword costs least: each bit costs the logistic loss
of its calibrated margin against the codeword's sign, weighted by how well the bit is told apart on the learned texts. So a few
wrong bits are outvoted by the others. Where the lead over the next codeword is small the text is marked as ambiguous.

Up to SMALL languages have all codewords that there are (each split of the languages into two sides is a bit); more have the
best of some random codes. N-grams of one to three letters, with one blank for whatever lies between words, are
counted in BUCKETS places. Learning takes two passes over all learned texts, one that counts n-grams by language and one that counts margins by
bin for the calibration; counts and weights are whole numbers, so that neither the order of rows nor their
partition changes a result. To the driver go BUCKETS numbers a language, and BINS a language and bit; languages are few.

Letters are what Unicode calls so, in lower case. A null text, or one without a letter, has the language ``und`` and the score 0. A text whose
n-grams are all unknown is decided by smoothing alone. Texts are taken whole, in pieces that bound the memory. Of equal costs the language first in order wins. Rows
without text or language teach nothing; where nothing is learned every text is ``und``, and with one language every text with a letter
has it with the score 1. Repeated rows teach repeatedly. Columns of the input stay, except those that the operator adds.
"""

from __future__ import annotations

import functools
import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import shared

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Code points taken at once.
PIECE = 1 << 17
#: Count added to each n-gram of each language; bits of a weight's fraction.
ADDED, FRACTION = 0.2, 12
#: Languages up to which the code has every split of them, and how many random codes are tried beyond.
SMALL, TRIES = 6, 64
#: Margins are counted in so many bins of this width for the calibration.
BINS, WIDTH = 512, 0.125
#: A text is ambiguous where the best score does not lead by so much.
LEAD = 0.2
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point the letter in lower case, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low if len(low) == 1 else c)
    return out


def code(n: int) -> np.ndarray:
    """The codewords of n languages as rows of signs. No bit has all languages on one side."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= SMALL:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))

    def drawn() -> np.ndarray:
        m = rng.choice(np.array([1, -1], np.int8), (n, bits))
        m[0, np.abs(m.sum(0, dtype=np.int64)) == n] *= -1
        return m

    return max((drawn() for _ in range(TRIES)), key=distance)


def distances(words: np.ndarray) -> np.ndarray:
    """The number of bits in which each two codewords differ."""
    m = words.astype(np.int64)
    return (m.shape[1] - m @ m.T) // 2


def distance(words: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    return int(distances(words)[np.triu_indices(len(words), 1)].min())


def grams(texts: list[str]):
    """(text, bucket) arrays of the n-grams of all texts, a piece at a time, in the order of texts; every n-gram occurs in one piece."""
    reach, table = max(ORDERS) - 1, letters()
    held, owner = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for piece, own, last in _pieces(texts):
        low = np.concatenate([held, table[piece]])
        own = np.concatenate([owner, own])
        # one blank for any number of signs between letters, and one before each text
        keep = np.append(True, (low[1:] != 0) | (low[:-1] != 0) | (own[1:] != own[:-1])) if len(low) else np.zeros(0, bool)
        low, own = low[keep], own[keep]
        done = len(low) if last else max(0, len(low) - reach)  # where n-grams begin that lie wholly in this piece
        for n in ORDERS:
            m = min(done, len(low) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ low[k : m + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ok = own[:m] == own[n - 1 : m + n - 1]
            ok &= (low[:m] != 0) if n == 1 else ((low[:m] != 0) | (low[1 : m + 1] != 0))
            yield own[:m][ok], (h[ok] % np.uint64(BUCKETS)).astype(np.int64)
        held, owner = low[done:], own[done:]


def _pieces(texts: list[str]):
    """Code points of the texts, each led and followed by a blank, in pieces; with the text of each, and whether the piece is the last."""
    some, own, size = [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text)), PIECE):
            part = (" " if a == 0 else "") + text[a : a + PIECE] + (" " if a + PIECE >= len(text) else "")
            points = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")
            some.append(points)
            own.append(np.full(len(points), k))
            size += len(points)
            if size >= PIECE:
                yield np.concatenate(some), np.concatenate(own), False
                some, own, size = [], [], 0
    yield np.concatenate([np.zeros(0, np.uint32), *some]), np.concatenate([np.zeros(0, np.int64), *own]), True


def _counter(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        names = sorted(set(langs))
        which = np.array([names.index(x) for x in langs], np.int64)
        total = np.zeros(len(names) * BUCKETS, np.int64)
        for own, bucket in grams(batch.column(1).to_pylist()):
            total += np.bincount(which[own] * BUCKETS + bucket, minlength=len(total))
        for name, row in zip(names, total.reshape(len(names), BUCKETS), strict=True):
            counts[name] = counts.get(name, 0) + row
    for name, row in counts.items():
        some = np.flatnonzero(row)
        if not len(some):  # a language whose texts have no letters is a language yet
            some = np.zeros(1, np.int64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()), "n": pa.array(row[some])})


class Model(NamedTuple):
    """Languages in order, their codewords, a weight for each bucket and bit, and of each bit the slope, the offset and the weight in decoding."""

    langs: list[str]
    words: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    alpha: np.ndarray


def ratios(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each bucket and bit, the logarithm of how much likelier the n-gram is in a language with a plus, in fixed point."""
    share = (counts + ADDED) / (counts.sum(1, keepdims=True) + ADDED * BUCKETS)
    out = np.empty((BUCKETS, words.shape[1]), np.int32)
    for b in range(words.shape[1]):
        plus = words[:, b] > 0
        out[:, b] = np.rint((np.log(share[plus].mean(0)) - np.log(share[~plus].mean(0))) * (1 << FRACTION))
    return out


def margins(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text and bit the margin, which grows with the square root of the number of n-grams that agree; and of each text the number of n-grams."""
    total, n = np.zeros((len(texts), weights.shape[1]), np.int64), np.zeros(len(texts), np.int64)
    for own, bucket in grams(texts):
        if not len(own):
            continue
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        n[own[first]] += np.diff(np.append(first, len(own)))
        if weights.shape[1]:
            total[own[first]] += np.add.reduceat(weights[bucket], first, axis=0, dtype=np.int64)
    return total / float(1 << FRACTION) / np.sqrt(np.maximum(n, 1))[:, None], n


def _binner(sent):
    def run(batches):
        langs, weights = sent.value
        at = {x: k for k, x in enumerate(langs)}
        bits = weights.shape[1]
        total = np.zeros(len(langs) * bits * BINS, np.int64)
        for batch in batches:
            margin, n = margins(batch.column(1).to_pylist(), weights)
            which = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            place = np.clip(np.floor(margin / WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64)
            place += (which[:, None] * bits + np.arange(bits)) * BINS
            total += np.bincount(place[n > 0].ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(some, pa.int64()), "n": pa.array(total[some])})

    return run


def logistic(x: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds at places x, from the weights of both sides there, by Newton steps with a small prior."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -60, 60)))
        r, w = plus * (1 - p) - minus * p, (plus + minus) * p * (1 - p)
        g = np.array([(r * x).sum() - 1e-3 * (a - 1), r.sum() - 1e-3 * c])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, c = a + float(np.clip(step[0], -1, 1)), c + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), c


def learn(rows: DataFrame) -> Model:
    """rows: text and lang of the texts to learn from; other columns are not read."""
    spark = rows.sparkSession
    shared.shared_dir(spark)
    known = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    table = known.mapInArrow(_counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, dtype=object), table["lang"].to_numpy()) if langs else [], table["bucket"].to_numpy()] = table["n"].to_numpy()
    words = code(len(langs))
    bits = words.shape[1]
    weights = ratios(counts, words) if langs else np.zeros((BUCKETS, 0), np.int32)
    slope, offset, alpha = np.ones(bits), np.zeros(bits), np.ones(bits)
    if bits:
        sent = spark.sparkContext.broadcast((langs, weights))
        found = known.mapInArrow(_binner(sent), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        hist = np.zeros(len(langs) * bits * BINS)
        hist[found["place"].to_numpy()] = found["n"].to_numpy()
        hist = hist.reshape(len(langs), bits, BINS)
        hist /= np.maximum(1, hist.sum(2, keepdims=True))  # every language counts alike
        x = (np.arange(BINS) - BINS // 2 + 0.5) * WIDTH
        for b in range(bits):
            plus, minus = hist[words[:, b] > 0, b].sum(0), hist[words[:, b] < 0, b].sum(0)
            slope[b], offset[b] = logistic(x, plus, minus)
            wrong = (plus[slope[b] * x + offset[b] < 0].sum() + minus[slope[b] * x + offset[b] >= 0].sum()) / max(plus.sum() + minus.sum(), 1e-9)
            alpha[b] = 1 - 2 * min(wrong, 0.49)
    return Model(langs, words, weights, slope, offset, alpha)


def decoded(margin: np.ndarray, model: Model) -> np.ndarray:
    """The score of each language (columns) for each text; a row's scores add up to 1."""
    z = margin * model.slope + model.offset
    cost = np.stack([(np.logaddexp(0, -word * z) * model.alpha).sum(1) for word in model.words], 1)
    if len(model.langs) > 1:
        cost /= distances(model.words)[np.triu_indices(len(model.words), 1)].mean()  # as if each two codewords differed in one bit
    odds = np.exp(cost.min(1, keepdims=True) - cost)
    return odds / odds.sum(1, keepdims=True)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, lang_score, lang_ambiguous to every row, from its text alone."""
    shared.shared_dir(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "lang_score", "lang_ambiguous")

    def stage(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("text", F.col("text").cast("string"))
        names = [*rows.columns, *new]

        def run(batches):
            model = sent.value
            for batch in batches:
                margin, n = margins(batch.column(batch.schema.get_field_index("text")).fill_null("").to_pylist(), model.weights)
                pred, score, ambiguous = np.full(len(n), UNKNOWN, dtype=object), np.zeros(len(n)), np.ones(len(n), bool)
                some = np.flatnonzero(n > 0) if model.langs else np.zeros(0, np.int64)
                if len(some):
                    scores = decoded(margin[some], model)
                    top = np.sort(scores, 1)
                    pred[some], score[some] = np.array(model.langs, dtype=object)[scores.argmax(1)], scores.max(1)
                    ambiguous[some] = top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0) < LEAD
                yield shared.with_columns(batch, {"lang_pred": pa.array(pred.tolist(), pa.string()), "lang_score": pa.array(score), "lang_ambiguous": pa.array(ambiguous)}, names)

        schema = rows.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_ambiguous": F.lit(False)}).schema
        return rows.mapInArrow(run, schema)

    return shared.aside(docs, ("text",), stage, new)
