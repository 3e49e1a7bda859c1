"""Benchmark items in training documents: rare n-grams as seeds, then Smith-Waterman alignment.

Items are taken in blocks whose n-grams are few enough to be sent to every task; each block is
looked up in all documents. A first pass counts in how many documents each n-gram occurs; an item's
seeds are its rare n-grams, rare against the item's own others that occur, and the rarest that occur
of each stretch of it, so an item that leaked into a third of the corpus, edited or not, keeps its
seeds. A second pass aligns the item with the words around each seed, and around n-grams of which
a document has several close to each other, so edited copies score by what they share.

Seeds are n-grams of four words in a row, or of two and two with any word between: an edit at every
fourth or third word leaves some of the latter. Words are lower-cased (A-Z). A null text counts as
empty and matches nothing. Items of fewer than eight words are too short for seeds and edits: they count where
all their words stand in a row, from ``least_words`` words on (1: every item with a word). Repeated documents
are each reported, repeated items each count. Texts of any length are taken whole: an alignment holds one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm import shared, textvec

GRAM = 4
SLICE = 1 << 20
#: Words of the shortest items that are searched by seeds; shorter ones must stand in a document word by word.
LEAST = 8
#: Bytes of item texts in a block; about 32 MB of lookup tables go to each task.
BLOCK_BYTES = 4 << 20
#: A seed occurs in at most so many documents, or in at most so many times those of the lower quartile of the item's n-grams that occur, or is the rarest of a stretch of so many places.
RARE_DOCS, RARE_TIMES, STRETCH = 40, 4.0, 8
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.4


def patterns(n: int) -> list[tuple[int, ...]]:
    """The places of words that make a seed: n in a row, and n with a hole in the middle, which an edit at every third or fourth word leaves whole."""
    return [tuple(range(n)), (*range(n // 2), *range(n // 2 + 1, n + 1))]


class Items:
    """A block of items: their words, and where each n-gram occurs in them. Items of less than LEAST words have none: of those with
    ``least_words`` words or more, ``short`` has the hashes of the whole sequences, in order, and their items, by the number of words."""

    def __init__(self, rows: list[tuple[int, str]], n: int, least_words: int = 1):
        rows = [(i, t) for i, t in rows if t]
        self.ids, self.patterns = [i for i, _ in rows], patterns(n)
        raw = [t.encode() for _, t in rows]
        ends = np.cumsum([0, *map(len, raw)])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        starts, stops, self.before = textvec.words(buf, ends)
        self.word = textvec.hashes(buf, starts, stops, True)
        size, found = np.diff(self.before), []
        for taken in self.patterns:
            h, first = textvec.grams(self.word, self.before, taken[-1] + 1, taken)
            item = np.searchsorted(self.before, first, "right") - 1
            ok = size[item] >= LEAST
            found.append((h[ok], item[ok], first[ok] - self.before[item[ok]]))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(max(1, least_words), LEAST):
            h, first = textvec.grams(self.word, self.before, k)
            item = np.searchsorted(self.before, first, "right") - 1
            h, item = h[size[item] == k], item[size[item] == k]
            if len(h):
                order = np.argsort(h, kind="stable")
                self.short[k] = h[order], item[order]
        h, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], at[order]
        self.unique, self.first = np.unique(self.hash, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.hash)))

    def words_of(self, k: int) -> np.ndarray:
        return self.word[self.before[k] : self.before[k + 1]]

    def lookup(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``unique`` and index of the first word of each n-gram of the texts that an item has."""
        which, where = [], []
        for taken in self.patterns:
            h, first = textvec.grams(word, before, taken[-1] + 1, taken)
            # most n-grams are in no item: a table of 2^20 entries turns them away before the search
            if len(self.unique):
                maybe = np.flatnonzero(self.mask[(h >> textvec.U(44)).astype(np.intp)])
                k = np.searchsorted(self.unique, h[maybe])
                k[k == len(self.unique)] = 0
                hit = self.unique[k] == h[maybe]
                which.append(k[hit])
                where.append(first[maybe[hit]])
        if not which:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, where = np.concatenate(which), np.concatenate(where)
        order = np.argsort(where, kind="stable")
        return which[order], where[order]

    def whole(self, word: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, word after the last) of the first place at which each short item stands whole in each text."""
        out = {}
        for k, (known, item) in self.short.items():
            h, first = textvec.grams(word, before, k)
            a, b = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            hit = np.flatnonzero(a < b)
            text = np.searchsorted(before, first[hit], "right") - 1
            for x, d in zip(hit.tolist(), text.tolist(), strict=True):
                at = int(first[x] - before[d])
                for i in item[a[x] : b[x]].tolist():  # items of the same words
                    out.setdefault((d, i), (d, i, at, at + k))
        return list(out.values())

    @property
    def mask(self) -> np.ndarray:
        if not hasattr(self, "_mask"):
            self._mask = np.zeros(1 << 20, bool)
            self._mask[(self.unique >> textvec.U(44)).astype(np.intp)] = True
        return self._mask


def rare_seeds(items: Items, docs_with: np.ndarray, threshold: float = THRESHOLD, n: int = GRAM) -> np.ndarray:
    """For each entry (n-gram of an item): whether it is a seed of that item. Where one n-gram alone reaches the threshold, all are."""
    df = np.repeat(docs_with, items.count)
    out = np.zeros(len(df), bool)
    order = np.argsort(items.item, kind="stable")
    cuts = np.searchsorted(items.item[order], np.arange(len(items.ids) + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            own = order[a:b]
            own = own[df[own] > 0]
            if not len(own):
                continue
            if n >= threshold * len(items.words_of(items.item[own[0]])):
                out[own] = True
                continue
            stretch = items.at[own] // STRETCH
            least = np.full(stretch.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, stretch, df[own])
            out[own] = (df[own] <= max(RARE_DOCS, RARE_TIMES * np.quantile(df[own], 0.25))) | (df[own] == least[stretch])
    return out


def _next_row(row: np.ndarray, ramp: np.ndarray, step: np.ndarray, floor: int | None) -> np.ndarray:
    """The row of an alignment matrix below ``row``; with a floor, scores begin anew there."""
    now = np.empty_like(row)
    now[0] = row[0] + GAP if floor is None else floor
    now[1:] = np.maximum(row[:-1] + step, row[1:] + GAP)
    if floor is not None:
        np.maximum(now, floor, out=now)
    return np.maximum.accumulate(now + ramp) - ramp  # gaps along the passage


def align(item: np.ndarray, passage: np.ndarray, least: float = 0.0) -> tuple[int, int, int]:
    """Best local alignment score, and the words of the passage from which and up to which it reaches (0, 0 below ``least``).

    Only one row of the matrix is held. Where the alignment begins comes from the same pass backwards
    from its end, over as many words as an alignment of its score can have.
    """
    ramp = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, at = 0, (0, 0)
    for i, w in enumerate(item):
        row = _next_row(row, ramp, np.where(passage == w, MATCH, MISMATCH), 0)
        if (top := int(row.max())) > best:
            best, at = top, (i + 1, int(row.argmax()))
    if not best or best < least:
        return best, 0, 0
    i, stop = at
    back = passage[max(0, stop - i * (1 - MATCH // GAP)) : stop][::-1]
    ramp = ramp[: len(back) + 1]
    row = -ramp
    for w in item[:i][::-1]:
        row = _next_row(row, ramp, np.where(back == w, MATCH, MISMATCH), None)
        if (reached := np.flatnonzero(row == best)).size:
            return best, stop - int(reached[0]), stop
    raise AssertionError("an alignment that has an end has a start")


def passages(where: np.ndarray, at: np.ndarray, size: int, n_words: int) -> list[tuple[int, int]]:
    """Merged ranges of words in which the item, laid on one of the seeds, can lie with a few words more."""
    slack = size // 2 + 2
    lo = np.maximum(where - at - slack, 0)
    hi = np.minimum(where - at + size + slack, n_words)
    order = np.argsort(lo, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in parts of about BLOCK_BYTES; the driver holds one part at a time when there are several."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]), False)
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def matched(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, least_words: int = 1) -> DataFrame:
    """Add ``benchmark_hits`` to every row: for each item whose alignment reaches the threshold, its id,
    the score as a share of the item's own, and the range of words. Empty for clean documents."""
    shared.shared_dir(docs.sparkSession)
    return shared.aside(docs, ("text",), lambda rows: _matched(rows, benchmark, threshold, n, least_words), ("benchmark_hits",))


def _matched(docs: DataFrame, benchmark: DataFrame, threshold: float, n: int, least_words: int) -> DataFrame:
    spark = docs.sparkSession
    out = docs.withColumn("benchmark_hits", F.array().cast(HIT))
    for block in blocks(benchmark):
        items = Items(block, n, least_words)
        if not len(items.hash) and not items.short:
            continue
        sent = spark.sparkContext.broadcast(items)
        counted = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_counter(sent), "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
        docs_with = np.zeros(len(items.unique), np.int64)
        for r in counted.toLocalIterator():  # one number for each n-gram of the block
            docs_with[r.gram] = r.docs
        seeds = spark.sparkContext.broadcast(rare_seeds(items, docs_with, threshold, n))
        names = out.columns
        out = out.withColumn("text", F.col("text").cast("string")).mapInArrow(_aligner(sent, seeds, threshold, names), out.withColumn("text", F.col("text").cast("string")).schema)
    return out


def _texts(batch: pa.RecordBatch):
    column = batch.column(batch.schema.get_field_index("text"))
    buf, ends = shared.rows_of(column.fill_null(""))
    for a, b in shared.slices(ends, SLICE):
        part, own = buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        starts, stops, before = textvec.words(part, own)
        yield a, b, textvec.hashes(part, starts, stops, True), before


def _counter(sent):
    def run(batches):
        items = sent.value
        total = np.zeros(len(items.unique), np.int64)
        for batch in batches:
            for a, b, word, before in _texts(batch):
                which, where = items.lookup(word, before)
                doc = np.searchsorted(before, where, "right") - 1
                pairs = np.unique(which * (b - a) + doc)
                total += np.bincount(pairs // (b - a), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int64()), "docs": pa.array(total[some], pa.int64())})

    return run


def _aligner(sent, seeds, threshold, names):
    def run(batches):
        items, seed = sent.value, seeds.value
        for batch in batches:
            old = batch.column(batch.schema.get_field_index("benchmark_hits")).to_pylist()
            for a, b, word, before in _texts(batch):
                which, where = items.lookup(word, before)
                size = items.count[which]
                entry = textvec.ragged(items.first[which], size)
                where = np.repeat(where, size)
                doc = np.searchsorted(before, where, "right") - 1
                order = np.lexsort((where, items.item[entry], doc))
                entry, where, doc = entry[order], where[order], doc[order]
                k = items.item[entry]
                first = np.flatnonzero(np.diff(doc, prepend=-1).astype(bool) | np.diff(k, prepend=-1).astype(bool))
                several = np.diff(np.append(first, len(entry))) > 1
                live = several | (np.add.reduceat(seed[entry].astype(np.int64), first) > 0) if len(first) else several
                ends = np.append(first[1:], len(entry))
                for x, y in zip(first[live].tolist(), ends[live].tolist(), strict=True):
                    d, target = int(doc[x]), items.words_of(k[x])
                    text = word[before[d] : before[d + 1]]
                    best = (0.0, 0, 0)
                    at, own = where[x:y] - before[d], entry[x:y]
                    for lo, hi in passages(at, items.at[own], len(target), len(text)):
                        here = (at >= lo) & (at < hi)
                        if not seed[own[here]].any() and len(np.unique(at[here])) < 2:
                            continue
                        score, i, j = align(target, text[lo:hi], threshold * MATCH * len(target))
                        best = max(best, (score / (MATCH * len(target)), lo + i, lo + j))
                    if best[0] >= threshold:
                        old[a + d] = [*old[a + d], {"item_id": items.ids[k[x]], "score": best[0], "first_word": best[1], "end_word": best[2]}]
                for d, i, first_word, end_word in items.whole(word, before):
                    old[a + d] = [*old[a + d], {"item_id": items.ids[i], "score": 1.0, "first_word": first_word, "end_word": end_word}]
            yield shared.with_columns(batch, {"benchmark_hits": pa.array(old, _ARROW)}, names)

    return run
