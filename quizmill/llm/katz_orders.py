"""Katz backoff of any order, as tables that Spark joins.

The model is that of ``katz``, with n-grams up to the given order: an n-gram seen r times keeps the
discounted share of its count, and what a history's n-grams give up goes to the tokens that never
followed it, in proportion to their probability after the history without its first token. So

    P(w|h) = d c(hw) / c(h) if hw was seen, else a(h) P(w|h'),   a(h) = (1 - sum P(w'|h)) / (1 - sum P(w'|h'))

down to single tokens, and the probabilities of all tokens after any history sum to one. Histories
that were never seen pass on what the shorter one says. Before a text stand as many start marks as
the order has histories.

Counts, backoff weights and the recursive score of every n-gram of the texts lie in tables by order,
one row for each n-gram, made by shuffles alone: the work grows with the number of n-grams, no task
holds a part of fixed size, and nothing is broadcast but the discounts. It takes more room than ``katz``,
which packs pairs and is what the query runs. Nulls, repeated rows, empty tables and columns of any
names are taken as there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm import katz, shared, textvec

U = np.uint64
SLICE = 4 << 20


def ngrams(buf: np.ndarray, ends: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The hash of the n-gram that ends at each token and of its history, for each n, and the number of tokens before each text."""
    token, before = katz.tokens_of(buf, ends)
    first = before[:-1]
    found, histories = [token], [np.zeros(len(token), np.uint64)]
    start = [katz.START]
    for k in range(1, order):
        past = np.empty_like(token)
        past[1:] = found[-1][:-1]
        past[first] = start[-1]
        join = lambda h, w: textvec.mix(np.asarray(h * U(0x9E3779B97F4A7C15 | 1)) ^ textvec.mix(w + U(k)))  # noqa: B023, E731
        histories.append(past)
        found.append(join(past, token))
        start.append(join(np.array([start[-1]]), np.array([katz.START]))[0])
    return found, histories, before


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def counted(rows: DataFrame, order: int) -> DataFrame:
    """(g, h, s, c, n): every n-gram of the texts, its history, its last n - 1 tokens, its count in the training texts. rows: held, text."""

    def run(batches):
        for batch in batches:
            held = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            buf, ends = shared.rows_of(batch.column(1))
            for a, b in shared.slices(ends, SLICE):
                found, histories, before = ngrams(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], order)
                learned = np.repeat(~held[a:b], np.diff(before)).astype(float)
                for k, (g, h) in enumerate(zip(found, histories, strict=True)):
                    own, first, of = np.unique(g, return_index=True, return_inverse=True)
                    count = np.bincount(of, learned, len(own)).astype(np.int64)
                    suffix = found[k - 1][first] if k else np.zeros(len(own), np.uint64)
                    yield pa.RecordBatch.from_arrays([_signed(own), _signed(h[first]), _signed(suffix), pa.array(count), pa.array(np.full(len(own), k + 1, np.int32))], names=["g", "h", "s", "c", "n"])

    each = rows.select("held", "text").mapInArrow(run, "g long, h long, s long, c long, n int")
    return each.groupBy("n", "g").agg(F.min("h").alias("h"), F.min("s").alias("s"), F.sum("c").alias("c"))


def _kept(shares: np.ndarray) -> Column:
    """What a seen n-gram keeps of its count."""
    c = F.col("c")
    return F.when(c > katz.TOP, c - 0.5).otherwise(c * F.get(F.array(*(F.lit(float(x)) for x in shares)), (c - 1).cast("int")))


def model(rows: DataFrame, order: int, folder: str) -> DataFrame:
    """(g, value): the logarithm of the probability of each n-gram of the highest order after its history. Tables stay in ``folder``."""
    spark = rows.sparkSession
    counted(rows, order).write.partitionBy("n").parquet(f"{folder}/counts")
    counts = spark.read.schema("g long, h long, s long, c long, n int").parquet(f"{folder}/counts")
    of = {(r.n, r.c): r.types for r in counts.where(F.col("c").between(1, katz.TOP + 1)).groupBy("n", "c").agg(F.count("*").alias("types")).collect()}  # TOP + 1 rows an order
    total = counts.where("n = 1").agg(F.sum("c")).first()[0] or 0
    lower = None
    for n in range(1, order + 1):
        kept = _kept(katz.discounts(np.array([of.get((n, r), 0) for r in range(1, katz.TOP + 2)])))
        own = counts.where(F.col("n") == n).withColumn("kept", F.when(F.col("c") > 0, kept))
        if n == 1:
            given = (own.agg(F.sum("kept")).first()[0] or 0.0) / max(total, 1)
            p = F.col("kept") / max(total, 1)
            made = own.select("g", p.alias("p"), F.when(F.lit(total == 0), 0.0).otherwise(F.coalesce(F.log(p), F.lit(math.log(1 - given) if given < 1 else 0.0))).alias("value"))
        else:
            with_lower = own.join(lower.select(F.col("g").alias("s"), F.col("p").alias("lower"), F.col("value").alias("beyond")), "s")
            seen = with_lower.where("c > 0").groupBy("h").agg(F.sum("c").alias("all"), F.sum("kept").alias("kept_all"), F.sum("lower").alias("lower_all"))
            weight = F.log((1 - F.col("kept_all") / F.col("all")) / (1 - F.col("lower_all")))
            shared_weights = f"{folder}/backoff/n={n}"
            seen.select("h", "all", weight.alias("weight")).write.parquet(shared_weights)
            known = spark.read.schema("h long, all long, weight double").parquet(shared_weights)
            p = F.col("kept") / F.col("all")
            made = with_lower.join(known, "h", "left").select("g", p.alias("p"), F.coalesce(F.log(p), F.coalesce("weight", F.lit(0.0)) + F.col("beyond")).alias("value"))
        made.write.parquet(f"{folder}/scores/n={n}")
        lower = spark.read.schema("g long, p double, value double").parquet(f"{folder}/scores/n={n}")
    return lower.select("g", "value")


def scores(docs: DataFrame, held_out: Column, order: int = 3, folder: str | None = None) -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, score (log10 of the text's probability). ``held_out`` rows are not learned from.

    ``folder``: where the tables go, a path in the shared folder."""
    folder = folder or shared.place(docs.sparkSession, "katz-orders")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    rows = shared.stored(rows.withColumn("row", F.monotonically_increasing_id()), "katz-texts")
    value = model(rows, order, folder)

    def used(batches):
        for batch in batches:
            row = np.asarray(batch.column(0))
            buf, ends = shared.rows_of(batch.column(1))
            for a, b in shared.slices(ends, SLICE):
                found, _, before = ngrams(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], order)
                of = np.repeat(row[a:b], np.diff(before))
                by = np.lexsort((found[-1], of))
                g, of = found[-1][by], of[by]
                first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(of[first]), _signed(g[first]), pa.array(np.diff(np.append(first, len(g))))], names=["row", "g", "times"])

    uses = rows.select("row", "text").mapInArrow(used, "row long, g long, times long")
    told = uses.join(value, "g").groupBy("row").agg(F.sum("times").alias("n_tokens"), (F.sum(F.col("times") * F.col("value")) / math.log(10)).alias("score"))
    return rows.select("row", "doc_id", "held").join(told, "row").select("doc_id", F.col("held").alias("held_out"), "n_tokens", "score")
