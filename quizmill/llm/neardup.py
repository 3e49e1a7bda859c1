"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its distinct 5-word shingles. Its sketch has 128 registers: in
the bucket that a hash's top bits name, the leading zeros of the least remaining hash and the ten bits
after them. Sets that are equal by a cryptographic digest of the whole sorted set are one class from the start. Bands of registers propose pairs; the
Jaccard estimate, corrected for registers that agree by chance, and the sizes turn most away; full
sets decide. First each member of a bucket meets only the bucket's least member. Buckets that
this leaves in several components are worked through in blocks: the members outside the least
member's component meet all members, so no proposed pair between components goes untested, and
the members of one component, however many, are never paired with each other. Buckets with many pairs are decided where
their members meet, with full sets in blocks of bounded size, and only links leave.

A band has as many registers as let a pair at the threshold share none with a chance of at most 1e-6:
five at 85 % (4e-7), four at 80 % (5e-8). More similar pairs are missed with less.
Null and empty texts have the empty set and are linked with nothing. Repeated rows are copies.
The least doc_id of a component ignores null ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import shared, textvec

SHINGLE = 5
PERCENT = 85
BUCKETS, MANTISSA = 128, 10
#: The chance with which a pair at the threshold may share no band.
MISS = 1e-6
REST = 57
SLICE = 1 << 20
#: Pairs of a bucket from which on its full sets are sent to one place, and bytes of them in one block.
HEAVY, BLOCK_BYTES = 2000, 16 << 20
#: Pairs, and members of buckets with many pairs, that one task compares; the most tasks that such work is dealt to.
PAIRS, MEMBERS, MOST_PARTS = 4000, 1000, 20_000
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 6.0
U = np.uint64
_SALTS = textvec.mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def band_rows(percent: int) -> int:
    """The most registers of a band with which a pair at the threshold is missed with a chance of MISS or less."""
    return max((r for r in range(1, BUCKETS + 1) if (1 - (percent / 100) ** r) ** (BUCKETS // r) <= MISS), default=1)


def shingle_sets(buf: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one hash of all words where these are fewer than five."""
    starts, stops, before = textvec.words(buf, ends)
    word = textvec.hashes(buf, starts, stops, True)
    h, first = textvec.grams(word, before, SHINGLE)
    cuts = np.searchsorted(first, before)
    out = []
    for k in range(len(ends) - 1):
        own = h[cuts[k] : cuts[k + 1]]
        n = before[k + 1] - before[k]
        if 0 < n < SHINGLE:
            own = textvec.grams(word[before[k] : before[k + 1]], np.array([0, n]), int(n))[0] + U(n)
        out.append(np.unique(own))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: 0 for an empty bucket, else 1 + leading zeros * 1024 + mantissa."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (own >> U(REST)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = own[first] & U((1 << REST) - 1)
    top = np.frexp(least.astype(np.float64))[1]  # bits of the least hash
    top = np.where((top > 0) & (least < (U(1) << np.maximum(top - 1, 0).astype(np.uint64))), top - 1, top)
    after = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> after) & U((1 << MANTISSA) - 1)
    out[bucket[first]] = (1 + ((REST - top) << MANTISSA) + mantissa.astype(np.int64)).astype(np.uint16)
    return out


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The share of registers that agree though the sets have nothing in common."""
    a, b = np.maximum(n_a, 1) / BUCKETS, np.maximum(n_b, 1) / BUCKETS
    total = np.zeros(len(a))
    for zeros in range(40):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        total += 2.0 ** -(zeros + 1 + MANTISSA) * a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
    return np.clip(total, 0, 0.5)


def estimate(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, corrected for chance agreement, and how many registers they rest on."""
    filled = ((x > 0) | (y > 0)).sum(-1)
    same = ((x == y) & (x > 0)).sum(-1)
    pair, back = np.unique(np.asarray(n_x, np.int64) << 31 | np.asarray(n_y, np.int64), return_inverse=True)  # few sizes, many pairs
    by_chance = chance(pair >> 31, pair & ((1 << 31) - 1))[back]
    return (same / np.maximum(filled, 1) - by_chance) / (1 - by_chance), filled


def may_link(x, y, n_x, n_y, percent: int) -> np.ndarray:
    """Whether sizes and registers leave it possible that the sets reach the threshold."""
    guess, filled = estimate(x, y, n_x, n_y)
    p = percent / 100
    return (100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)) & (guess >= p - SLACK * np.sqrt(p * (1 - p) / np.maximum(filled, 1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, c (16 bytes of BLAKE2b over the whole sorted set; null for the empty one), registers."""
    rows = shared.texts_of(docs, "doc_id").select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches):
        for batch in batches:
            buf, ends = shared.rows_of(batch.column(2))
            for a, b in shared.slices(ends, SLICE):
                sets = shingle_sets(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                marks = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "text_key", "n_shingles", "c", "registers"])

    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, c binary, registers binary")


def banded(classes: DataFrame, size: int) -> DataFrame:
    """(key, band, c): for each band of ``size`` of a class's registers that isn't empty, its hash."""
    n = BUCKETS // size

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : n * size].reshape(-1, n, size).astype(np.uint64)
            key = np.broadcast_to(_SALTS[:n], reg.shape[:2]).copy()
            for k in range(size):
                key = textvec.mix(key ^ (reg[:, :, k] * U(0xD6E8FEB86659FD93)))
            row, band = np.nonzero(reg.any(-1))
            yield pa.RecordBatch.from_arrays([pa.array(key[row, band].view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(band.astype(np.int32))], names=["key", "c", "band"])

    return classes.select("c", "registers").mapInArrow(run, "key long, c binary, band int")


def _pairs_possible(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of those whose registers leave a link possible. pairs: u, v, n_u, r_u, n_v, r_v."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                u, v, n_u, r_u, n_v, r_v = (batch.column(k)[a : a + 4096] for k in range(6))
                x, y = (np.frombuffer(b"".join(r.to_pylist()), np.uint16).reshape(-1, BUCKETS) for r in (r_u, r_v))
                ok = pa.array(may_link(x, y, np.asarray(n_u), np.asarray(n_v), percent))
                yield pa.RecordBatch.from_arrays([u.filter(ok), v.filter(ok)], names=["u", "v"])

    return pairs.select("u", "v", "n_u", "r_u", "n_v", "r_v").mapInArrow(run, "u binary, v binary")


def _parts(rows: int, each: int) -> int:
    """Parts for so many rows of comparing work, so that no task's share grows with their number; MOST_PARTS at most."""
    return max(8, min(MOST_PARTS, -(-rows // each)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold. pairs: a stored table, in which one u may be in many rows."""
    n = _parts(pairs.count(), PAIRS)
    left = pairs.join(sets.select(F.col("c").alias("u"), F.col("s").alias("s_u")), "u").repartition(n, "v")
    both = left.join(sets.select(F.col("c").alias("v"), F.col("s").alias("s_v")).repartition(n, "v"), "v").select("u", "v", "s_u", "s_v")

    def run(batches):
        for batch in batches:
            ok = [_share(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), percent) for s, t in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.mapInArrow(run, "u binary, v binary")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, s): the sorted hashes of the set of each wanted class. wanted: doc_id, text_key, c of one document each."""
    rows = shared.texts_of(docs, "doc_id").withColumn("text_key", F.xxhash64("text"))
    own = rows.join(wanted.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "c"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")))

    def run(batches):
        for batch in batches:
            buf, ends = shared.rows_of(batch.column(1))
            for a, b in shared.slices(ends, SLICE):
                sets = shingle_sets(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "s"])

    return own.select("c", "text").mapInArrow(run, "c binary, s binary").dropDuplicates(["c"])


def components(links: DataFrame) -> DataFrame:
    """(c, root) for every linked class: each round, a node takes its least neighbour's label and labels are contracted."""
    spark = links.sparkSession
    edges = shared.stored(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        up = shared.stored(ends.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), "parents")
        for _ in range(2):
            far = up.select(F.col("n").alias("p"), F.col("p").alias("q"))
            up = up.join(far, "p", "left").select("n", F.coalesce("q", "p").alias("p"))
        up = shared.stored(up, "parents")
        if labels is None:
            labels = up.select(F.col("n").alias("c"), F.col("p").alias("root"))
        else:
            labels = shared.stored(labels.join(up.select(F.col("n").alias("root"), "p"), "root", "left").select("c", F.coalesce("p", "root").alias("root")), "labels")
        edges = edges.join(up.select(F.col("n").alias("u"), F.col("p").alias("a")), "u").join(up.select(F.col("n").alias("v"), F.col("p").alias("b")), "v")
        edges = shared.stored(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "links")
    return labels if labels is not None else spark.createDataFrame([], "c binary, root binary")


def _first_band(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The first band of ``size`` registers in which rows of registers agree and aren't empty."""
    shape = (-1, BUCKETS // size, size)
    a, b = (z[..., : shape[1] * size].reshape(shape) for z in (x, y))
    return ((a == b).all(-1) & (a > 0).any(-1)).argmax(-1)


def _share(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _compare(group, percent: int, full: bool):
    """Pairs of one bucket, or of two blocks of it, between components: possible ones, or with full sets linked ones.

    group: (block, minor, c, label, n, registers, band, set). Of two members that meet in several
    buckets, the first band's decides. With full sets, what is linked here counts as one component.
    """
    n = np.array([r[4] for r in group])
    block = np.array([r[0] for r in group])
    minor = np.array([r[1] for r in group])
    reg = np.frombuffer(b"".join(r[5] for r in group), np.uint16).reshape(-1, BUCKETS)
    names = {x: k for k, x in enumerate({r[3] for r in group})}
    label = np.array([names[r[3]] for r in group])
    place = np.arange(len(group))
    band, size, two = group[0][6], band_rows(percent), block.min() != block.max()
    for q in np.flatnonzero(minor).tolist():
        other = (label != label[q]) & (~minor | (place > q)) & (100 * np.minimum(n, n[q]) >= percent * np.maximum(n, n[q]))
        if two:
            other &= block != block[q]
        t = np.flatnonzero(other)
        if not len(t):
            continue
        t = t[may_link(reg[t], reg[q][None, :], n[t], np.full(len(t), n[q]), percent)]
        t = t[_first_band(reg[t], np.broadcast_to(reg[q], (len(t), BUCKETS)), size) == band] if len(t) else t
        for k in t.tolist():
            if full:
                if label[k] == label[q] or not _share(np.frombuffer(group[q][7], np.uint64), np.frombuffer(group[k][7], np.uint64), percent):
                    continue
                label[label == label[k]] = label[q]
            yield tuple(sorted((group[q][2], group[k][2])))


def _meet(rows: DataFrame, percent: int, full: bool, parts: int) -> DataFrame:
    """_compare for each (key, i, j). rows: key, i, j, block, minor, c, label, n_shingles, registers, band, s."""

    def run(batches):
        import itertools

        def lines():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, group in itertools.groupby(lines(), key=lambda r: r[:3]):
            found = list(_compare([r[3:] for r in group], percent, full))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "block", "minor", "c", "label", "n_shingles", "registers", "band", "s").mapInArrow(run, "u binary, v binary")


def _mixed(bands: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with what a comparison needs; ``heavy``: the bucket has many pairs."""
    known = bands.join(labels, "c", "left").withColumn("label", F.coalesce("root", "c")).select("key", "band", "c", "label")
    mixed = known.groupBy("key").agg(F.min(F.struct("c", "label")).alias("least"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    rows = known.join(mixed.select("key", F.col("least.label").alias("main")), "key").withColumn("minor", F.col("label") != F.col("main"))
    rows = rows.join(classes.select("c", "n_shingles", "registers", "one"), "c")
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("minor").alias("n_minor"), F.sum("n_shingles").alias("words"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") * 8 / BLOCK_BYTES)).cast("int")
    return rows.join(size.select("key", (F.col("n") * F.col("n_minor") > HEAVY).alias("heavy"), blocks.alias("blocks")), "key")


def _across(mixed: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(possible pairs of light buckets, linked pairs of heavy ones), all between components."""
    zero = F.lit(0)
    size = mixed.agg(F.count_if(~F.col("heavy")).alias("light"), F.sum(F.when(F.col("heavy"), F.col("blocks"))).alias("heavy")).first()
    light = mixed.where("not heavy").select("*", zero.alias("i"), zero.alias("j"), zero.alias("block"), F.lit(None).cast("binary").alias("s"))
    possible = shared.stored(_meet(light, percent, False, _parts(size.light, PAIRS)).distinct(), "across")
    heavy = mixed.where("heavy")
    wanted = heavy.groupBy("c").agg(F.first("one").alias("one")).select("c", "one.doc_id", "one.text_key")
    more = shared.stored(full_sets(docs, wanted.join(sets.select("c"), "c", "left_anti")), "sets")
    heavy = heavy.join(sets.unionAll(more), "c").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # each pair of blocks is a group; a bucket of one block is sent once
    met = heavy.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return possible, shared.stored(_meet(met, percent, True, _parts(size.heavy or 0, MEMBERS)).distinct(), "links")


def clustered(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For every row: doc_id, text_key (hash of the text), n_shingles, component_id, kept."""
    prints = shared.stored(fingerprints(docs), "fingerprints")
    sets_of = prints.where("c is not null")
    classes = shared.stored(sets_of.groupBy("c").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    bands = banded(classes, band_rows(percent))
    buckets = bands.groupBy("key").agg(F.min("c").alias("u"), F.count("*").alias("n")).where("n > 1")
    bands = shared.stored(bands.join(buckets.select("key", "u"), "key"), "bands")
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    stars = bands.where("c <> u").select("u", F.col("c").alias("v")).distinct()
    stars = shared.stored(_pairs_possible(stars.join(side("v"), "v").where("n_v > 0").join(side("u"), "u").where(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)"), percent), "stars")

    def wanted(pairs):
        ids = pairs.select(F.col("u").alias("c")).unionAll(pairs.select(F.col("v").alias("c"))).distinct()
        return classes.join(ids, "c", "left_semi").select("c", "one.doc_id", "one.text_key")

    sets = shared.stored(full_sets(docs, wanted(stars)), "sets")
    links = shared.stored(_verified(stars, sets, percent), "links")
    labels = components(links)
    mixed = shared.stored(_mixed(bands.select("key", "band", "c"), labels, classes), "mixed")
    possible, found = _across(mixed, sets, docs, percent)
    possible = shared.stored(possible.join(stars, ["u", "v"], "left_anti"), "across")
    missing = wanted(possible).join(sets.select("c"), "c", "left_anti")
    more = sets.unionAll(shared.stored(full_sets(docs, missing), "sets"))
    new = shared.stored(_verified(possible, more, percent).unionAll(found), "links")
    if not new.isEmpty():
        labels = components(links.unionAll(new))
    rooted = classes.select("c", "least_id").join(labels, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = shared.stored(rooted.join(least, "root").select("c", "component_id"), "components")
    out = prints.select("doc_id", "text_key", "n_shingles", "c").join(of_class, "c", "left")
    out = out.withColumn("component_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies; of repeated rows, one stays.

    Where a component has no doc_id at all, each of its rows counts as kept and stays once for each text.
    All columns of ``docs`` come back as they are, whatever their names; an empty table gives an empty one.
    """
    from pyspark.sql.window import Window

    keys = [shared.free_name(docs.columns, c) for c in ("_k_doc", "_k_null", "_k_key")]  # plain columns without nulls: join and numbering share one exchange
    doc, null, key = keys
    place = shared.free_name(docs.columns, "_k_row")
    flags = clustered(docs, percent).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias(doc), F.col("doc_id").isNull().alias(null), F.col("text_key").alias(key)).distinct()
    number = F.col("doc_id").cast("long")
    rows = docs.select("*", F.coalesce(number, F.lit(0)).alias(doc), number.isNull().alias(null), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(key))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return rows.join(flags, keys, "left_semi").withColumn(place, first).where(F.col(place) == 1).select(*map(shared.column, docs.columns))
