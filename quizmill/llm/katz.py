"""Katz backoff scores from Good-Turing discounted counts of one and two tokens.

Tokens are lower-cased words and one end for each text; the history of a text's first token is a
start mark. Where n_r is the number of types seen r times, a type seen r <= 5 times keeps the share
d_r = (r*/r - k)/(1 - k) of its count, r* = (r+1) n_{r+1}/n_r, k = 6 n_6/n_1; where these numbers
do not give shares between 0 and 1, the order's counts stay but for an absolute discount of a half.
What is taken from the single tokens goes to the one class of unknown tokens; what is taken from a
history's pairs goes to the tokens that never followed it, in proportion to their own probability:

    P(w|h) = d c(hw) / c(h)                                if hw was seen
           = a(h) P(w),   a(h) = (1 - sum P(w'|h)) / (1 - sum P(w'))  over the w' seen after h
    P(w)   = d c(w) / N,  or the mass left over for an unknown token

A type seen more than five times keeps all but a half. So every seen type gives something up, and
the probabilities of all tokens after any history sum to one.

Pairs are the highest order. Columns of the input other than doc_id and text are not read but through
``held_out``, so their names don't matter.

Counts never meet in one place. Tasks count what they read; the counts of a pair go to the part of
its second word, where that word's own count is, those of frequent second words over all parts by
history. There the counts are merged and stored, and the texts' tokens are answered as far as this
does not depend on corpus totals: how many tokens fall under each discount, and sums of
logarithms. Backoff weights come from a second deal, by history, of what each part knows of it.

A null text counts as empty and has one token, its end; a null doc_id is never held out. Repeated
rows count and are scored each. Without training texts every token is the unknown one, at a
probability of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm import shared, textvec

U = np.uint64
TOP = 5
END, START = U(0x51ED270B7A3F91C5), U(0x2545F4914F6CDD1D)
#: Bytes of text whose tokens are counted together before they are sent, and bytes of text for each part.
BATCH, PART = 8 << 20, 12 << 20
#: A second word with at least such a share of the tokens of the documents looked at is dealt by history. This moves work, not results.
HOT_SHARE, HOT_DOCS = 1 / 256, 2000
UNIT = 2.0**32


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; wide numbers are stored byte by byte, which compresses better."""
    heads, raw = [], []
    for a in arrays:
        heads.append(f"{a.dtype.str}:{len(a)}")
        raw.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    head = ",".join(heads).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(raw))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for head in raw[4:at].decode().split(","):
        kind, n = head.split(":")
        size = np.dtype(kind).itemsize
        part = np.frombuffer(raw, np.uint8, int(n) * size, at).reshape(size, int(n))
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += int(n) * size
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the least unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def tokens_of(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, an end after each text, and the number of tokens before each text."""
    starts, stops, before = textvec.words(buf, ends)
    return np.insert(textvec.hashes(buf, starts, stops, True), before[1:], END), before + np.arange(len(ends))


def hot_words(rows: DataFrame) -> np.ndarray:
    """Hashes of words so frequent in a few documents that their pairs are dealt by history; sorted."""
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(HOT_DOCS)
    some = rows.join(F.broadcast(chosen), rows.doc_id.eqNullSafe(chosen.doc_id), "left_semi").select("text")

    def count(batches):
        for batch in batches:
            token, _ = tokens_of(*shared.rows_of(batch.column(0)))
            word, n = np.unique(token, return_counts=True)
            top = np.argsort(-n, kind="stable")[:4096]
            yield pa.RecordBatch.from_arrays([pa.array(word[top].view(np.int64)), pa.array(n[top]), pa.array(np.where(np.arange(len(top)) == 0, len(token), 0))], names=["w", "n", "all"])

    found = some.mapInArrow(count, "w long, n long, all long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    total = found.agg(F.sum("all")).first()[0] or 1
    hot = [r.w for r in found.where(F.col("n") >= HOT_SHARE * total).collect()]  # 1 / HOT_SHARE words at most
    return np.sort(np.array(hot, np.int64).view(np.uint64))


def corpus_facts(rows: DataFrame, hot: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Bytes of text, texts to learn from, and the training count of each hot word: sums over all rows."""

    def count(batches):
        size, learned, times = 0, 0, np.zeros(len(hot), np.int64)
        for batch in batches:
            buf, ends = shared.rows_of(batch.column(0))
            free = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            size, learned = size + len(buf), learned + int(free.sum())
            for a, b in shared.slices(ends, BATCH):
                token, before = tokens_of(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                own = token[np.repeat(free[a:b], np.diff(before))]
                times += np.bincount(np.searchsorted(hot, own[is_in(own, hot)]), minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([learned]), pa.array([times.tolist()], pa.list_(pa.int64()))], names=["size", "learned", "times"])

    total = rows.select("text", "held").mapInArrow(count, "size long, learned long, times array<long>")
    r = total.agg(F.sum("size"), F.sum("learned"), *(F.sum(F.get("times", F.lit(k))) for k in range(len(hot)))).first()
    return r[0] or 0, r[1] or 0, np.array([x or 0 for x in r[2:]], np.int64)


def is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def home(word: np.ndarray, parts: int) -> np.ndarray:
    return (textvec.mix(word ^ U(0x8BB84B93962EACC9)) % U(parts)).astype(np.int32)


def requests(buf, ends, held: np.ndarray, parts: int, hot: np.ndarray):
    """For each part: words, their training counts, histories, pairs of the two with training counts and uses, and the documents that use them."""
    token, before = tokens_of(buf, ends)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(before))
    past = np.empty_like(token)
    past[1:] = token[:-1]
    past[before[:-1]] = START
    word = np.unique(np.append(token, START))
    w, h = np.searchsorted(word, token), np.searchsorted(word, past)
    learned = ~held[doc]
    single = np.bincount(w[learned], minlength=len(word))
    key = w * len(word) + h
    order = np.argsort(key, kind="stable")
    key, doc, learned = key[order], doc[order], learned[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    uses = np.diff(np.append(first, len(key)))
    count = np.add.reduceat(learned.astype(np.int64), first)
    w, h = key[first] // len(word), key[first] % len(word)
    at, wide = home(word, parts), is_in(word, hot)
    part = np.where(wide[w], at[h], at[w])
    cuts = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[cuts], np.arange(parts + 1))
    for p in range(parts):
        own = cuts[bounds[p] : bounds[p + 1]]
        if not len(own):
            continue
        words = np.unique(w[own])
        pasts, h_of = np.unique(h[own], return_inverse=True)
        docs = doc[textvec.ragged(first[own], uses[own])]
        yield p, pack(word[words], narrow(single[words]), word[pasts], narrow(np.searchsorted(words, w[own])), narrow(h_of), narrow(count[own]), narrow(uses[own]), narrow(docs))


def fixed(x: np.ndarray) -> np.ndarray:
    return np.round(x * UNIT).astype(np.int64)


def grade(count: np.ndarray) -> np.ndarray:
    """0 for unseen, the count up to TOP, TOP + 1 beyond."""
    return np.minimum(count, TOP + 1)


def log_count(count: np.ndarray) -> np.ndarray:
    """The logarithm of a seen type's count, less a half where it is beyond the discounts."""
    return np.log(np.where(count > TOP, count - 0.5, np.maximum(count, 1)))


def of_single(count: np.ndarray) -> np.ndarray:
    """Totals of single tokens' counts: tokens, types, types of each grade, types seen once more than the discounts reach, the counts beyond."""
    return np.concatenate([[count.sum(), (count > 0).sum()], np.bincount(grade(count), minlength=TOP + 2)[1:], [(count == TOP + 1).sum(), count[count > TOP].sum()]]).astype(np.int64)


def answer(p: int, parts: int, blocks: list[tuple[int, bytes]], hot: np.ndarray, hot_count: np.ndarray):
    """(kind, key, block) rows: the part's counts, its totals, what it knows of texts and of histories, and the open tokens.

    A block tells the counts of its words in one batch; those of hot words, whose pairs lie in many parts, are known from the start."""
    opened = [unpack(b) for _, b in blocks]
    word, w_of = np.unique(np.concatenate([b[0] for b in opened]), return_inverse=True)
    past, h_of = np.unique(np.concatenate([b[2] for b in opened]), return_inverse=True)
    single = np.bincount(w_of, np.concatenate([b[1] for b in opened]).astype(float), len(word)).astype(np.int64)
    wide = is_in(word, hot)
    single[wide] = hot_count[np.searchsorted(hot, word[wide])]
    shift_w = np.cumsum([0, *(len(b[0]) for b in opened)])
    shift_h = np.cumsum([0, *(len(b[2]) for b in opened)])
    key = np.concatenate([w_of[b[3].astype(np.int64) + a] * len(past) + h_of[b[4].astype(np.int64) + c] for b, a, c in zip(opened, shift_w, shift_h, strict=False)])
    pair, of = np.unique(key, return_inverse=True)
    count = np.bincount(of, np.concatenate([b[5] for b in opened]).astype(float), len(pair)).astype(np.int64)
    w, h = (pair // len(past), pair % len(past)) if len(past) else (pair, pair)
    seen = count > 0
    yield "counts", p, pack(word, narrow(single), past, narrow(w[seen]), narrow(h[seen]), narrow(count[seen]))
    yield "totals", p, pack(np.concatenate([of_single(single[~wide]), np.bincount(grade(count), minlength=TOP + 2)[1:], [(count == TOP + 1).sum()]]).astype(np.int64))
    # of histories: pair types by grade, the counts beyond, successors by grade of their own count, these counts beyond
    g, s = grade(count)[seen], grade(single[w])[seen]
    stats = np.zeros((2 * TOP + 4, len(past)), np.int64)
    for k in range(1, TOP + 2):
        stats[k - 1] = np.bincount(h[seen][g == k], minlength=len(past))
        stats[TOP + 1 + k] = np.bincount(h[seen][s == k], minlength=len(past))
    stats[TOP + 1] = np.bincount(h[seen][g > TOP], count[seen][g > TOP].astype(float), len(past))
    stats[2 * TOP + 3] = np.bincount(h[seen][s > TOP], single[w][seen][s > TOP].astype(float), len(past))
    known = np.flatnonzero(stats[: TOP + 1].any(0))
    to = home(past, parts)
    for q, own in _by(to[known], known):
        yield "histories", q, pack(past[own], *(narrow(x[own]) for x in stats))
    at, unseen = 0, []
    for (uid, _), b in zip(blocks, opened, strict=True):
        mine = of[at : at + len(b[3])]
        at += len(b[3])
        use = np.repeat(mine, b[6].astype(np.int64))
        doc = b[7].astype(np.int64)
        docs, d = np.unique(doc, return_inverse=True)
        c, u = count[use], single[w[use]] if len(use) else np.zeros(0, np.int64)
        open_ = c == 0
        after = (u > 0) & (word[w[use]] != END) if len(use) else open_
        logs = np.where(open_, np.where(u > 0, log_count(u), 0), log_count(c)) - np.where(after, np.log(np.maximum(u, 1)), 0)
        n = len(docs)
        tally = [np.bincount(d[u > 0], minlength=n)]
        tally += [np.bincount(d[c == k], minlength=n) for k in range(1, TOP + 1)]
        tally += [np.bincount(d[open_ & (grade(u) == k)], minlength=n) for k in range(TOP + 2)]
        sums = [np.bincount(d, fixed(x), n).astype(np.int64) for x in (logs, np.log(u + 1.0))]
        yield "texts", uid, pack(narrow(docs), *map(narrow, tally), *sums)
        if open_.any():
            unseen.append((np.full(int(open_.sum()), uid), doc[open_], h[use[open_]]))
    if unseen:
        uid, doc, ask = (np.concatenate(x) for x in zip(*unseen, strict=True))
        for q, own in _by(to[ask], np.arange(len(ask))):  # one block for each part, not for each batch
            hs, back = np.unique(past[ask[own]], return_inverse=True)
            uids, u = np.unique(uid[own], return_inverse=True)
            yield "open", q, pack(uids, narrow(u), hs, narrow(back), narrow(doc[own]))


def _by(label: np.ndarray, rows: np.ndarray):
    order = np.argsort(label, kind="stable")
    label, rows = label[order], rows[order]
    cuts = np.append(np.flatnonzero(np.append(True, label[1:] != label[:-1])), len(label)) if len(label) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(label[a]), rows[a:b]


def discounts(n: np.ndarray) -> np.ndarray:
    """d_1 to d_TOP from n_1 to n_{TOP+1}."""
    r = np.arange(1, TOP + 1)
    n = n.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        k = (TOP + 1) * n[TOP] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - k) / (1 - k)
    return d if np.all((d > 0) & (d < 1)) else (r - 0.5) / r


class Totals:
    """What the whole corpus says: N, V, discounts, the mass of the unknown token."""

    def __init__(self, x: np.ndarray):
        self.tokens, self.types = int(x[0]), int(x[1])
        n, beyond = x[2 : 2 + TOP], int(x[2 + TOP])
        self.single = discounts(np.append(n, x[3 + TOP]))
        self.pair = discounts(np.append(x[5 + TOP : 5 + 2 * TOP], x[6 + 2 * TOP]))
        kept = float((self.single * np.arange(1, TOP + 1) * n).sum() + x[4 + TOP] - 0.5 * beyond)
        self.unknown = 1 - kept / self.tokens if self.tokens else 1.0

    def backoff(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, weight a(h)) of histories from summed statistics."""
        r = np.arange(1, TOP + 1)[:, None]
        n, s = stats[:TOP], stats[TOP + 2 : 2 * TOP + 2]
        count = (r * n).sum(0) + stats[TOP + 1]
        kept = ((self.pair[:, None] * r * n).sum(0) + stats[TOP + 1] - 0.5 * stats[TOP]) / count
        lower = ((self.single[:, None] * r * s).sum(0) + stats[2 * TOP + 3] - 0.5 * stats[2 * TOP + 2]) / self.tokens
        return count, (1 - kept) / (1 - lower)


def weights(blocks: list[tuple[str, bytes]], totals: Totals):
    """(uid, block) rows, one for each batch: for documents with open tokens, the sum of log c(h) a(h)."""
    opened = [unpack(b) for kind, b in blocks if kind == "histories"]
    if not opened:
        return
    past, of = np.unique(np.concatenate([b[0] for b in opened]), return_inverse=True)
    stats = np.array([np.bincount(of, np.concatenate([b[1 + k] for b in opened]).astype(float), len(past)) for k in range(2 * TOP + 4)])
    count, a = totals.backoff(stats)
    value = np.log(count) + np.log(a)
    found = []
    for kind, block in blocks:
        if kind == "open":
            uids, u, hs, back, doc = unpack(block)
            known = is_in(hs, past)
            own = np.where(known, value[np.minimum(np.searchsorted(past, hs), len(past) - 1)], 0)[back]
            found.append((uids[u], doc.astype(np.int64), own))
    if not found:
        return
    uid, doc, own = (np.concatenate(x) for x in zip(*found, strict=True))
    for key, rows in _by(uid, np.arange(len(uid))):
        docs, d = np.unique(doc[rows], return_inverse=True)
        yield key, pack(narrow(docs), np.bincount(d, fixed(own[rows]), len(docs)).astype(np.int64))


def finish(uid: int, blocks: list[tuple[str, bytes]], totals: Totals, learned: int) -> pa.RecordBatch:
    """The result rows of one batch of texts."""
    info = next(unpack(b) for kind, b in blocks if kind == "info")
    n = len(info[0])
    tally, logs, base = np.zeros((2 * TOP + 3, n), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for kind, block in blocks:
        x = unpack(block) if kind in ("texts", "tail") else None
        if kind == "texts":
            docs = x[0].astype(np.int64)
            for k in range(2 * TOP + 3):
                tally[k, docs] += x[1 + k].astype(np.int64)
            logs[docs] += x[-2]
            base[docs] += x[-1]
        elif kind == "tail":
            logs[x[0].astype(np.int64)] += x[1]
    tokens = info[2].astype(np.int64)
    total = logs / UNIT
    if totals.tokens:
        total = total - np.log(max(learned, 1))  # of the start as the first history
        for k in range(TOP):
            total = total + tally[1 + k] * np.log(totals.pair[k]) + tally[2 + TOP + k] * np.log(totals.single[k])
        total = total + tally[1 + TOP] * np.log(totals.unknown) - tally[1 + TOP : 3 + 2 * TOP].sum(0) * np.log(totals.tokens) + tally[1 + TOP] * np.log(totals.tokens)
    plain = base / UNIT - tokens * np.log(totals.tokens + totals.types + 1)
    own = {
        "doc_id": pa.array(info[0], mask=info[1].astype(bool)), "held_out": pa.array(info[3].astype(bool)), "n_tokens": tokens, "n_known": tally[0],
        "train_tokens": np.full(n, totals.tokens), "base_score": plain / np.log(10), "score": total / np.log(10),
    }
    return pa.RecordBatch.from_pydict(own)


def grouped(batches, columns: int):
    """(first column, rows) of runs of rows with an equal first column."""
    import itertools

    def lines():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True)

    for key, rows in itertools.groupby(lines(), key=lambda r: r[0]):
        yield key, [r[1:] for r in rows]


def scores(docs: DataFrame, held_out, folder: str | None = None) -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a Boolean column of ``docs``; the other rows are learned from. The model stays in
    ``folder``, a path in the shared folder, as tables by kind: counts of words and pairs, totals,
    what the backoff weights of histories come from.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or shared.place(spark, "katz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    hot = hot_words(rows)
    size, learned, hot_count = corpus_facts(rows, hot)
    parts = max(4, -(-int(size) // PART))

    def ask(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 24
        for batch in batches:
            buf, ends = shared.rows_of(batch.column(1))
            held = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            ids, no_id = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False), np.uint8)
            for a, b in shared.slices(ends, BATCH):
                part, own = buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                got = list(requests(part, own, held[a:b], parts, hot))
                before = tokens_count(part, own)
                got.append((serial % parts, None))
                info = pack(ids[a:b], no_id[a:b], before, held[a:b].astype(np.uint8))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in got], pa.int32()), "uid": pa.array([serial] * len(got), pa.int64()), "block": pa.array([x or info for _, x in got], pa.binary()), "info": pa.array([x is None for _, x in got])})
                serial += 1

    def count(batches):
        for p, found in grouped(batches, 4):
            blocks = [(uid, x) for uid, x, info in found if not info]
            out = [("info", uid, x) for uid, x, info in found if info]
            if blocks:
                out.extend(answer(p, parts, blocks, hot, hot_count))
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[a : a + 256], strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["kind", "key", "block"])

    asked = rows.mapInArrow(ask, "part int, uid long, block binary, info boolean")
    dealt = asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "uid")  # one part a task
    dealt.mapInArrow(count, "kind string, key long, block binary").write.partitionBy("kind").option("compression", "none").parquet(folder)
    model = spark.read.schema("key long, block binary, kind string").parquet(folder)

    def add(batches):
        total = np.zeros(2 * TOP + 7, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += unpack(x)[0]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["x"])

    sums = model.where("kind = 'totals'").select("block").mapInArrow(add, "x array<long>")
    summed = sums.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    x = np.zeros(2 * TOP + 7, np.int64)
    for r in summed:
        x[r.pos] = r.n
    x[: TOP + 5] += of_single(hot_count)
    totals = Totals(x)

    def weigh(batches):
        for _, found in grouped(batches, 3):
            out = list(weights(found, totals))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array(["tail"] * len(out)), pa.array([b for _, b in out], pa.binary())], names=["key", "kind", "block"])

    tails = model.where("kind in ('histories', 'open')").select("key", "kind", "block").repartitionById(parts, F.col("key").cast("int")).sortWithinPartitions("key").mapInArrow(weigh, "key long, kind string, block binary")
    of_texts = model.where("kind in ('info', 'texts')").select("key", "kind", "block").unionAll(tails)

    def close(batches):
        for uid, found in grouped(batches, 3):
            yield finish(uid, found, totals, learned)

    return of_texts.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(close, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def tokens_count(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return narrow(np.diff(textvec.words(buf, ends)[2]) + 1)
