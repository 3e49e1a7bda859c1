"""Removal of long repeated byte strings with merged Burrows-Wheeler transforms.

A string of ``width`` bytes that starts at two places has the same least 64-byte hash, at the same
distance, in both. So each place belongs to one occurrence of such a least hash, and only places
of one hash need comparing. Occurrences with equal surroundings, by 64 bits of BLAKE2 beside the hash, are
one class; its first and its last occurrence stand for it, with the bytes of their own documents. The
segments of a hash are compared by their suffixes: shards of segments get a
transform each (over symbols that stand for 100 bytes; strings with a symbol that occurs once are left out),
two transforms are merged by interleave refinement, which deals the merged rows by one more symbol each
round, by counts and without a sort, and gives the length of common prefixes; intervals that agree in four symbols are the
strings of 400 bytes that repeat. Equal symbols are confirmed byte by byte; where two different ones
have one hash, the strings are told apart by SHA-256 instead.

A hash with very many different segments is not compared in one place: its segments are cut into
ranges of starts and dealt anew by what all strings of a range have in common, twice if need be; at
the second time a range is one start and its string alone decides.

A null text counts as empty. Repeated rows are copies, so both lose what they share. Texts shorter
than the width stay whole. Further columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import shared, textvec

WIDTH, SEED = 400, 64
SYMBOL = 100
#: Bytes of texts that are hashed at a time.
SLICE = 1 << 18
#: Different segments of a hash that are compared in one place, and starts in a range beyond that.
GROUP, RANGE = 2048, 32
#: Keys of large groups, 8 bytes each, that are sent to every task.
SENT = 100_000
#: Bytes of segments that one engine run takes (whole groups; its arrays stay in a core's cache), and of one shard in it.
RUN, SHARD = 1 << 17, 1 << 16
U = np.uint64
LOW = (1 << 24) - 1


_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_RNG.integers(1, 2**61)) * 8 + 5


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    made = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        f = np.full(n, base, np.uint64)
        f[0] = 1
        made.append(np.multiply.accumulate(f))
    return made[0], made[1]


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes from each place on, from a running sum of random numbers for bytes times powers.

    For at most some hundred bytes: such sums modulo 2^64 are weak for structured strings of 1,024 bytes and more."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    power, back = _powers(textvec.CHUNK + k)
    for a in range(0, n, textvec.CHUNK):
        b = min(n, a + textvec.CHUNK)
        run = np.empty(b - a + k, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[buf[a : b + k - 1]] * power[: b - a + k - 1], out=run[1:])
        out[a:b] = (run[k:] - run[: b - a]) * back[: b - a]
    return textvec.mix(out)


def least_places(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes, the place of its least one, the first of several: blockwise minima from both sides."""
    n = len(h) - window + 1
    tagged = (h & ~U(LOW)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // window)
    grid = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = tagged
    grid = grid.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & U(LOW)).astype(np.int64)


def occurrences(buf: np.ndarray, ends: np.ndarray, width: int = WIDTH, seed: int = SEED):
    """(text, hash, identity of the segment (BLAKE2 of its bytes), first start, number of starts, the hash's place after the first start) of each least hash."""
    text = np.flatnonzero(np.diff(ends) >= width)
    h = gram_hashes(buf, seed)
    least = np.zeros(len(buf), np.int64)
    step = LOW - width
    for a in range(0, len(buf) - width + 1, step):  # places are told apart by 24 bits
        part = h[a : a + step + width - seed]
        least[a : a + len(part) - width + seed] = least_places(part, width - seed + 1) + a
    count = ends[text + 1] - ends[text] - width + 1
    start = textvec.ragged(ends[text], count)
    owner = np.repeat(text, count)
    at = least[start]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(at)))
    lo = start[first]
    raw, stop = buf.tobytes(), lo + n - 1 + width
    mark = np.frombuffer(b"".join(hashlib.blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(lo.tolist(), stop.tolist(), strict=True)), "<u8")
    return owner[first], h[at[first]], mark, lo - ends[owner[first]], n, at[first] - lo


def segment_limit(width: int = WIDTH, seed: int = SEED) -> int:
    """The most bytes that a segment can have."""
    return 2 * width - seed


class Transform:
    """Rows of a collection's suffixes in the order of their first symbols: place, the symbol before (0: none),
    and ``follow``: the rows by the symbol before, so in the order of the suffixes that begin one symbol earlier."""

    def __init__(self, place: np.ndarray, before: np.ndarray, follow: np.ndarray):
        self.place, self.before, self.follow = place, before, follow


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on: value and index are sorted as one number where 63 bits hold both."""
    bits = max(1, len(x) - 1).bit_length()
    if int(x.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(x, kind="stable")
    return np.sort(x.astype(np.int64) << bits | np.arange(len(x))) & ((1 << bits) - 1)


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each number among the different ones, and the stable order."""
    order = stable_order(x)
    new, rank = np.zeros(len(x), bool), np.empty(len(x), np.int64)
    x = x[order]
    np.not_equal(x[1:], x[:-1], out=new[1:])
    rank[order] = np.cumsum(new)
    return rank, order


def transform(place: np.ndarray, symbols: np.ndarray, step: int, depth: int) -> Transform:
    """By doubling ranks. symbols: 0 where none begins; place: the suffixes, ends of strings included."""
    rank, order = ranked(symbols[place].astype(np.int64))
    full, ends = np.zeros(len(symbols) + step * depth, np.int64), symbols[place] == 0
    reach = step
    while reach < step * depth:
        full[place] = rank + 1
        later = full[place + reach]
        later[ends] = 0
        rank, order = ranked(rank * (int(rank.max(initial=0)) + 2) + later)
        reach *= 2
    order = place[order]
    before = _previous(order, symbols, step)
    return Transform(order, before, stable_order(before))


def _previous(place: np.ndarray, symbols: np.ndarray, step: int) -> np.ndarray:
    out = symbols[np.maximum(place - step, 0)].copy()
    out[place < step] = 0
    return out


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The transform of both collections, and for each of its rows how many symbols, up to ``depth``, it has in common with the row above.

    Interleave refinement: ``z`` says of each merged row which transform it is from. A row of ``a`` moves
    behind all rows with a smaller symbol before and those with the same one that stand above it. Those of
    ``a`` are known from ``follow``, those of ``b`` are counted against ``z``; what remains free is for the rows
    of ``b``. That turns an order by k symbols into one by k + 1, in which only the rows that begin a
    block of k symbols, and those where the new symbol differs, have less than k + 1 in common with the row above.
    """
    n, m = len(a.place), len(b.place)
    own, base = np.arange(n), m + 1
    symbol_a, symbol_b = a.before[a.follow], b.before[b.follow]
    of_a = symbol_a.astype(np.int64) * base
    of_b = symbol_b.astype(np.int64) * base + b.follow
    at_a, at_b = own, np.arange(n, n + m)  # where each row stands: z by its places

    def moved() -> tuple[np.ndarray, np.ndarray]:
        above = (at_a - own)[a.follow]  # rows of b above each row of a
        to = own + np.searchsorted(of_b, of_a + above)
        z = np.ones(n + m, bool)
        z[to] = False
        return to, np.flatnonzero(z)

    def woven(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(n + m, x.dtype)
        out[at_a], out[at_b] = x, y
        return out

    block, common = np.zeros(n + m, np.int32), np.zeros(n + m, np.int64)
    for _ in range(depth):
        was_a, was_b = block[at_a[a.follow]], block[at_b[b.follow]]
        at_a, at_b = moved()
        symbol, was = woven(symbol_a, symbol_b), woven(was_a, was_b)
        new = np.ones(n + m, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1]) | (symbol[1:] == 0)  # a string's end is unlike any other
        common += ~new
        block = np.cumsum(new, dtype=np.int32)
    place, before, follow_a, follow_b = woven(a.place, b.place), woven(a.before, b.before), at_a[a.follow], at_b[b.follow]
    at_a, at_b = moved()
    return Transform(place, before, woven(follow_a, follow_b)), common


def repeated_starts(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, width: int = WIDTH, symbol: int = SYMBOL, shard: int = SHARD) -> np.ndarray:
    """For each byte of the segments: whether it is one of its segment's first ``starts`` places and its string starts at another such place too."""
    depth = width // symbol
    gap = np.arange(len(ends) - 1) * symbol  # bytes between segments, so that each string has its end
    at = ends[:-1] + gap
    place_of = textvec.ragged(at, np.diff(ends))
    wide = np.zeros(int(ends[-1]) + symbol * len(gap) + symbol, np.uint8)
    wide[place_of] = buf
    valid = np.zeros(len(wide), bool)
    valid[textvec.ragged(at, starts)] = True
    begins = np.flatnonzero(_reached(valid, symbol, depth))
    # places of one hash, as far as it fits beside an index, are ranked together; what differs is found below
    number, _ = ranked((gram_hashes(wide, symbol)[begins] >> U(len(begins).bit_length() + 1)).astype(np.int64))
    symbols, often = np.zeros(len(wide), np.int32), np.zeros(len(wide), bool)
    symbols[begins] = number + 1
    often[begins] = (np.bincount(number) > 1)[number]
    # a string with a symbol that occurs once occurs once: it needs no sorting
    for k in range(0, width, symbol):
        valid[: len(wide) - k] &= often[k:]
    if not valid.any():
        return np.zeros(len(buf), bool)
    symbols[~_reached(valid, symbol, depth)] = 0
    inside = _reached(valid, symbol, depth + 1)  # suffixes: all places with a symbol, and the end of each string
    shard = min(shard, -(-int(ends[-1]) // 2))  # two shards at least, but for a single segment
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) + shard, shard))
    cuts = np.unique(np.clip(cuts, 0, len(ends) - 1))
    parts = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = int(at[x]), int(at[y - 1] + np.diff(ends)[y - 1] + symbol)
        t = transform(np.flatnonzero(inside[lo:hi]), symbols[lo:hi], symbol, depth)
        parts.append(Transform(t.place + lo, t.before, t.follow))
    common = None
    if len(parts) == 1:
        parts.append(Transform(*(x[:0] for x in (parts[0].place, parts[0].before, parts[0].follow))))
    while len(parts) > 1:
        joined = []
        for k in range(0, len(parts) - 1, 2):
            t, common = merge(parts[k], parts[k + 1], depth)
            joined.append(t)
        parts = joined + parts[2 * len(joined) :]
    order = parts[0].place
    keep = valid[order]
    block = np.cumsum(common < depth)[keep]
    order = order[keep]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = block[1:] == block[:-1]
    hit = np.flatnonzero(same[1:-1])
    if not all_equal(wide, order[hit], order[hit + 1], width):
        return _by_bytes(buf, ends, starts, width)
    out = np.zeros(len(wide), bool)
    out[order[same[1:] | same[:-1]]] = True
    return out[place_of]


def _reached(valid: np.ndarray, step: int, times: int) -> np.ndarray:
    """The marked places, and those up to ``times`` - 1 steps after one."""
    out = valid.copy()
    for k in range(step, step * times, step):
        out[k:] |= valid[: len(valid) - k]
    return out


def all_equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> bool:
    """Whether the strings at each a and b are equal, bytes that an earlier pair has compared left out."""
    order = stable_order(a)
    a, b = a[order], b[order]
    chained = np.zeros(len(a), bool)
    chained[1:] = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)
    if not np.array_equal(buf[a + width - 1], buf[b + width - 1]):
        return False
    head = np.flatnonzero(~chained)
    for k in range(0, len(head), 4096):
        x, y = a[head[k : k + 4096]], b[head[k : k + 4096]]
        if not np.array_equal(buf[x[:, None] + np.arange(width)], buf[y[:, None] + np.arange(width)]):
            return False
    return True


def _by_bytes(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """What ``repeated_starts`` finds, for segments in which two different symbols have one hash: each string by its SHA-256."""
    raw, place = buf.tobytes(), textvec.ragged(ends[:-1], starts)
    seen: dict[bytes, int] = {}
    mark = [hashlib.sha256(raw[k : k + width]).digest() for k in place.tolist()]
    for m in mark:
        seen[m] = seen.get(m, 0) + 1
    out = np.zeros(len(buf), bool)
    out[place] = [seen[m] > 1 for m in mark]
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


RUNS = "h long, sh long, a long, b long"
SEGMENT = "key long, h long, sh long, t int, off long, p long, n long, body binary"


def _cut(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Segments with their bytes: of a class of several occurrences the first and the last (``t``), of another its only one.

    Repeated rows give the same segments; each task leaves out what it has cut before, and who reads them the rest."""
    ends = F.when(F.col("m") > 1, F.array("one", "two")).otherwise(F.array("one"))
    each = classes.select("h", "sh", F.posexplode(ends).alias("t", "at"))
    wanted = each.groupBy("at.doc_id", "at.text_key").agg(F.collect_list(F.struct("h", "sh", "t", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"), F.col("at.p").alias("p"))).alias("cuts"))
    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"})
    found = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.w_id) & (docs.text_key == wanted.w_key)).select("w_id", "w_key", "text", "cuts")

    def run(batches):
        done = set()
        for batch in batches:
            for *row, text, cuts in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if tuple(row) not in done:
                    done.add(tuple(row))
                    raw = text.as_buffer().to_pybytes()
                    yield _segments([(c["h"], c["h"], c["sh"], c["t"], 0, c["p"], c["n"], raw[c["lo"] : c["lo"] + c["n"] - 1 + WIDTH]) for c in cuts])

    return found.mapInArrow(run, SEGMENT)


def _segments(rows) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
    names = ["key", "h", "sh", "t", "off", "p", "n", "body"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


def _split(segments: DataFrame, size: int) -> DataFrame:
    """Each segment as ranges of ``size`` starts; the key is the hash of what all strings of the range share."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, h, sh, t, off, p, n, body in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                for a in range(-((off - p) % size), n, size):  # ranges begin at multiples of size, counted from the hash's place
                    x, y = max(a, 0), min(a + size, n)
                    core = hashlib.blake2b(body[a + size - 1 : a + WIDTH], digest_size=8).digest()  # also where the range lacks its first or last starts
                    rows.append((int.from_bytes(core, "little", signed=True), h, sh, t, off + x, p, y - x, body[x : y - 1 + WIDTH]))
                if len(rows) > 4096:
                    yield _segments(rows)
                    rows = []
            if rows:
                yield _segments(rows)

    return segments.mapInArrow(run, SEGMENT)


def _compare(segments: DataFrame) -> DataFrame:
    """(h, sh, a, b): runs of starts, within their class's segment, whose strings start elsewhere too."""

    def engine(rows):
        body = [r[7] for r in rows]
        ends = np.cumsum([0, *map(len, body)])
        n = np.array([r[6] for r in rows])
        x, y = runs_of(repeated_starts(np.frombuffer(b"".join(body), np.uint8), ends, n))
        of = np.searchsorted(ends, x, "right") - 1  # no run goes on into the next segment, whose last places are no starts
        for k, a, b in zip(of.tolist(), (x - ends[of]).tolist(), (y - ends[of]).tolist(), strict=True):
            _, h, sh, _, off, *_ = rows[k]
            yield h, sh, off + a, off + b

    def run(batches):
        pending, size, last = [], 0, ()
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if row[:5] == last:  # a repeated row's
                    continue
                if size >= RUN and row[0] != last[0]:
                    yield _runs(engine(pending))
                    pending, size = [], 0
                pending.append(row)
                size, last = size + len(row[7]), row[:5]
        if pending:
            yield _runs(engine(pending))

    return segments.repartition("key").sortWithinPartitions("key", "h", "sh", "t", "off").mapInArrow(run, RUNS)


def _runs(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["h", "sh", "a", "b"])


def covered(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, a, b): for each document with repeated strings, runs of their starts. docs: doc_id, text_key, text."""

    def find(batches):
        for batch in batches:
            buf, ends = shared.rows_of(batch.column(2))
            for a, b in shared.slices(ends, SLICE):
                owner, h, sh, lo, n, p = occurrences(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                of = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sh.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(lo), pa.array(n), pa.array(p)], names=["h", "sh", "doc_id", "text_key", "lo", "n", "p"])

    spark = docs.sparkSession
    found = shared.stored(docs.mapInArrow(find, "h long, sh long, doc_id long, text_key long, lo long, n long, p long"), "occurrences")
    classes = found.groupBy("h", "sh").agg(F.count("*").alias("m"), *(f(F.struct("doc_id", "text_key", "lo", "n", "p")).alias(a) for f, a in ((F.min, "one"), (F.max, "two"))))
    by_hash = found.groupBy("h").agg(F.count("*").alias("all")).where("all > 1")
    classes = shared.stored(classes.join(by_hash, "h"), "segments")
    segments = shared.stored(_cut(classes, docs), "segments")
    runs = spark.createDataFrame([], RUNS)
    tally = classes.groupBy(F.col("h").alias("key")).agg(F.sum(F.when(F.col("m") > 1, 2).otherwise(1)).alias("rows"))
    for size in (RANGE, 1, None):
        large = tally.where(F.col("rows") > group)
        if size is None or large.isEmpty():
            runs = runs.unionByName(_compare(segments) if size is not None else _equal(segments))
            break
        large = large.select("key")
        if large.count() <= SENT:  # else both sides are dealt by key, and Spark splits large keys
            large = F.broadcast(large)
        runs = runs.unionByName(_compare(segments.join(large, "key", "left_anti")))
        segments = segments.join(large, "key", "left_semi")
        if size == RANGE:
            segments = segments.dropDuplicates(["h", "sh", "t"])
        segments = shared.stored(_split(segments, size), "segments")
        tally = segments.groupBy("key").agg(F.count("*").alias("rows"))
    runs = shared.stored(runs.distinct(), "runs")
    return found.join(runs, ["h", "sh"]).select("doc_id", "text_key", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))


def _equal(segments: DataFrame) -> DataFrame:
    """Segments of one start: those with equal strings repeat."""
    one = segments.select("h", "sh", "off", F.sha2("body", 256).alias("string"))
    many = one.groupBy("string").agg(F.count("*").alias("k")).where("k > 1").select("string")
    return one.join(many, "string", "left_semi").select("h", "sh", F.col("off").alias("a"), F.col("off").alias("b"))


def removed(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """For every row: doc_id, n_bytes, spans (array of first and end byte of each removed run), kept_text (binary)."""
    rows = shared.texts_of(docs, "doc_id").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    runs = covered(rows, group).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("runs")).withColumnsRenamed({"doc_id": "r_id", "text_key": "r_key"})
    joined = rows.join(runs, rows.doc_id.eqNullSafe(runs.r_id) & (rows.text_key == runs.r_key), "left").select("doc_id", "text", "runs")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def strip(batches):
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                spans, kept, size = [], [], []
                for text, found in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    own: list[list[int]] = []
                    for a, b in sorted((r["a"], r["b"] + WIDTH) for r in found or ()):
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], b)
                        else:
                            own.append([a, b])
                    cuts = [0, *(x for s in own for x in s), len(raw)]
                    size.append(len(raw))
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept_text"])

    return joined.mapInArrow(strip, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_text binary")
