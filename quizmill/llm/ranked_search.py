"""Ranked search of documents by words: an index of document shards, and the best documents of every query.

The index is a table of shards. A shard has the documents of some megabytes of text, wherever they lay, and holds in compressed sparse rows
their terms (bytes, one after the other), where each term's postings begin, and for every posting the document's
place in the shard and its impact, a whole number that depends on the document and on figures of the whole corpus. It is built
without a shuffle: one pass counts documents and terms, a second writes the shards of each task.

Queries are taken in blocks of a bounded number of bytes. For each block one pass over the shards' terms counts the documents that
have each term, which gives the terms' weights; a second adds weight times impact up, term at a time, in one dense array a
shard and query, and selects the best by ``argpartition``; all that tie with the last of them stay in, so that ties are decided by
doc_id alone. A task joins the best of its shards, a window those of all tasks: at most k rows a query and task are dealt.

A term is a maximal match of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z as a-z: ASCII letters and digits, and everything beyond ASCII.
Terms are compared by their bytes. A null or empty text, or one of signs only, has no terms and is found by nothing;
a query without terms finds nothing. Every row is a document of its own: repeated rows are each ranked, a null doc_id goes before others
in a tie. A text of any length is taken whole, in a shard of its own if it is longer than one. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.llm import shared, textvec

#: Bytes of text in a shard.
SHARD = 4 << 20
#: Bytes of query texts in a block.
BLOCK_BYTES = 4 << 20
BEST = 20
# Fixed values of the score: saturation, length's share in percent, and the scales of impacts and weights
GAIN, LONG, IMPACT, WEIGHT = 12, 25, 1_000_000_000, 1000
#: A shard is a row of megabytes. Parquet's writer looks at its size every hundred rows only, and a reader takes a row group at once, so that
#: tasks would hold as much as a hundred shards; looked at after every row, a group has few, however many shards a task makes.
GROUPS = {"parquet.block.size": str(SHARD), **{f"parquet.{kind}.size.row.check.{end}": "1" for kind in ("block", "page") for end in ("min", "max")}}

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each term, and the text that has it."""
    inside = np.zeros(len(buf) + len(ends), bool)  # a place between any two texts
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside[np.arange(len(buf)) + text + 1] = _TERM[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # where the value changes after this place
    starts, stops = edge[::2], edge[1::2]
    own = np.searchsorted(ends[1:] + np.arange(len(ends) - 1), starts, "right")
    return starts - own, stops - own, own


def folded(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 0x41) & (buf <= 0x5A), buf + 32, buf).astype(np.uint8)


def _texts(batch: pa.RecordBatch):
    buf, ends = shared.rows_of(batch.column(batch.schema.get_field_index("text")))
    for a, b in shared.slices(ends, SHARD):
        yield a, b, folded(buf[ends[a] : ends[b]]), ends[a : b + 1] - ends[a]


def _sizes(batches):
    docs = total = 0
    for batch in batches:
        for a, b, buf, ends in _texts(batch):
            n = np.bincount(terms(buf, ends)[2], minlength=b - a)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([total], pa.int64())})


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Of each posting, from the term's occurrences in the document and the document's number of terms."""
    kind = np.int64 if LONG * docs * int(n.max(initial=0)) < 1 << 63 else object
    m = (100 - LONG + LONG * docs * n.astype(kind) // max(1, total)).astype(np.int64)
    return IMPACT * tf // (1000 * tf + GAIN * m)


def shard(buf: np.ndarray, ends: np.ndarray, docs: int, total: int) -> dict[str, np.ndarray] | None:
    """The postings of some texts, given their folded bytes; None without any term."""
    starts, stops, own = terms(buf, ends)
    if not len(starts):
        return None
    first, back = textvec.classes(buf, starts, stops)
    order = np.argsort(back, kind="stable")  # texts ascend within a term
    back, doc = back[order], own[order]
    new = np.append(True, (back[1:] != back[:-1]) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(new)
    tf, doc, back = np.diff(np.append(at, len(doc))), doc[at], back[at]
    n = np.bincount(own, minlength=len(ends) - 1)
    size = stops[first] - starts[first]
    return {
        "term_bytes": buf[textvec.ragged(starts[first], size)],
        "term_ends": np.cumsum(size).astype("<i8"),
        "begin": np.searchsorted(back, np.arange(len(first) + 1)).astype("<i8"),
        "docs": doc.astype("<i4"),
        "impacts": impacts(tf, n[doc], docs, total).astype("<i8"),
    }


_COLUMNS = ("term_bytes", "term_ends", "begin", "docs", "impacts")
_SCHEMA = "doc_ids array<long>, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _builder(docs: int, total: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, buf, ends in _texts(batch):
                if (made := shard(buf, ends, docs, total)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].to_pylist()], pa.list_(pa.int64())), *(pa.array([made[c].tobytes()], pa.binary()) for c in _COLUMNS)], names=["doc_ids", *_COLUMNS])

    return run


class Index:
    """The shards of a corpus, and how many documents have terms."""

    def __init__(self, shards: DataFrame, docs: int):
        self.shards, self.docs = shards, docs


def index(docs: DataFrame) -> Index:
    """Every row's postings, as a table in the shared folder. docs: doc_id, text; other columns are not read."""
    rows = shared.texts_of(docs, "doc_id")
    n, total = rows.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return Index(shared.stored(rows.mapInArrow(_builder(n, total), _SCHEMA), "postings", GROUPS), n)


class Queries:
    """A block of queries: the terms of each with their number, as indices into the block's vocabulary."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        raw = [(t or "").encode() for _, t in rows]
        ends = np.cumsum([0, *map(len, raw)])
        buf = folded(np.frombuffer(b"".join(raw), np.uint8))
        starts, stops, own = terms(buf, ends)
        data = buf.tobytes()
        self.at: dict[bytes, int] = {}
        counts = [Counter() for _ in rows]
        for a, b, k in zip(starts.tolist(), stops.tolist(), own.tolist(), strict=True):
            counts[k][self.at.setdefault(data[a:b], len(self.at))] += 1
        self.terms = [(np.fromiter(c, np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in counts]
        self.hash = np.unique(textvec.hashes(buf, starts, stops, False)) if len(starts) else np.zeros(0, np.uint64)

    def found(self, data: bytes, ends: np.ndarray) -> list[tuple[int, int]]:
        """(term of the block, term of the shard) for all that are in both, by their bytes."""
        buf, starts = np.frombuffer(data, np.uint8), np.append(0, ends[:-1])
        if not len(self.hash):
            return []
        h = textvec.hashes(buf, starts, ends, False)
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        maybe = np.flatnonzero(self.hash[k] == h).tolist()
        pairs = ((self.at.get(data[starts[j] : ends[j]]), j) for j in maybe)
        return [(t, j) for t, j in pairs if t is not None]


def _cells(batch: pa.RecordBatch, *names: str):
    """The named cells of each shard of the batch."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    for k in range(batch.num_rows):
        yield tuple(np.frombuffer(c[k].as_buffer(), "<i4" if n == "docs" else "<i8") if n != "term_bytes" else c[k].as_py() for n, c in zip(names, columns, strict=True))


def _counter(sent):
    def run(batches):
        queries = sent.value
        total = np.zeros(len(queries.at), np.int64)
        for batch in batches:
            for data, ends, begin in _cells(batch, "term_bytes", "term_ends", "begin"):
                for term, j in queries.found(data, ends):
                    total[term] += begin[j + 1] - begin[j]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "docs": pa.array(total[some], pa.int64())})

    return run


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, equal ones by ascending id, null before others."""
    if len(scores) > k:
        last = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        at = np.flatnonzero((scores >= last) & (scores > 0))  # all that tie with the last stay in
    else:
        at = np.flatnonzero(scores > 0)
    return at[np.lexsort((ids[at], known[at], -scores[at]))[:k]]


def _scorer(sent, k: int):
    def run(batches):
        queries, weight = sent.value
        kept: list[tuple[np.ndarray, ...] | None] = [None] * len(queries.ids)  # the best so far of each query
        for batch in batches:
            owners = batch.column(batch.schema.get_field_index("doc_ids"))
            for row, (data, ends, begin, docs, impact) in enumerate(_cells(batch, *_COLUMNS)):
                own = owners[row].values
                ids, known = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False)
                postings = {t: (docs[begin[j] : begin[j + 1]], weight[t] * impact[begin[j] : begin[j + 1]]) for t, j in queries.found(data, ends) if weight[t]}
                for q, (term, times) in enumerate(queries.terms):
                    total = np.zeros(len(ids), np.int64)
                    for t, n in zip(term.tolist(), times.tolist(), strict=True):
                        if t in postings:
                            at, adds = postings[t]
                            total[at] += n * adds  # a document occurs once in a posting list
                    at = best(total, ids, known, k)
                    if len(at):
                        new = total[at], ids[at], known[at]
                        if kept[q] is not None:
                            new = tuple(map(np.concatenate, zip(kept[q], new, strict=True)))
                            at = best(*new, k)
                            new = tuple(x[at] for x in new)
                        kept[q] = new
        for q, found in enumerate(kept):
            if found is not None:
                score, ids, known = found
                yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(len(ids), q), pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=~known), "score": pa.array(score, pa.int64())})

    return run


def blocks(queries: DataFrame, key: str, limit: int = BLOCK_BYTES):
    """The queries in parts of about ``limit`` bytes; the driver holds one at a time."""
    rows = queries.select(shared.column(key).cast("long").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == k)
        if found := sorted(((r.key, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            yield found


def search(corpus: Index, queries: DataFrame, key: str = "item_id", k: int = BEST) -> DataFrame:
    """The k best documents of every query: the key, rank, doc_id, score. queries: the key and text."""
    spark = corpus.shards.sparkSession
    context, out = spark.sparkContext, None
    for block in blocks(queries, key):
        asked = Queries(block)
        sent = context.broadcast(asked)
        df = np.zeros(len(asked.at), np.int64)
        counted = corpus.shards.select("term_bytes", "term_ends", "begin").mapInArrow(_counter(sent), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
        for r in counted.toLocalIterator():  # one number for each term of the block
            df[r.term] = r.docs
        found = corpus.shards.mapInArrow(_scorer(context.broadcast((asked, weights(df, corpus.docs))), k), "query long, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(asked.ids)), "query long, key long")
        part = ranked.join(F.broadcast(ids), "query").select("key", "rank", "doc_id", "score")  # the block's ids are within its bound of bytes
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "key long, rank int, doc_id long, score long")
    return out.withColumnRenamed("key", key)
