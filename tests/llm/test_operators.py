"""Each operator against brute force on a small table with nulls, empties, repeats, ties and long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, documents, prose
from pyspark.sql import functions as F
from test_katz import shares

from quizmill.llm import byte_bpe, chat, decontaminate, neardup, quality, queries, repeats, secrets, sharding, token_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(write_table):
    return write_table("documents", documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(write_table):
    return write_table("documents", [], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def expect(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def utf8(data):
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def test_empty_tables(spark, empty):
    for name, query in queries.QUERIES.items():
        if name not in ("op5_role_repair", "op7_decontamination", "op12_embedding_whitening", "op13_ranked_search"):  # these read other tables too; their own tests have them
            assert query(spark, empty).collect() == [], name


def test_op1(spark, folder):
    texts = [(r[0], (r[1] or "").encode()) for r in documents()]
    seen = Counter(b[k : k + 400] for _, b in texts for k in range(len(b) - 399))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        edges = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        told = ",".join(f"{x}:{y}" for x, y in zip(edges[::2], edges[1::2], strict=True))
        want.append((i, len(b), sum(gone), spans, sha(kept), told, utf8(kept)))
    assert rows_of(queries.op1_repeat_removal(spark, folder)) == expect(want)


@pytest.mark.parametrize("group", [1, 4])
def test_op1_large_groups_are_dealt_anew(spark, group):
    passage = prose(20, 90)
    rows = [(k, prose(100 + k, 40) + passage + prose(200 + k % 7, 40)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(repeats.removed(docs, group=group)) == rows_of(repeats.removed(docs))


def test_op1_transforms_merge_to_the_order_of_all_suffixes():
    rng = np.random.default_rng(5)
    body = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(8, 40, 30)]
    ends = np.cumsum([0, *map(len, body)])
    starts = np.array([len(b) - 7 for b in body])
    seen = Counter(b[k : k + 8] for b in body for k in range(len(b) - 7))
    want = [k + 8 <= len(b) and seen[b[k : k + 8]] > 1 for b in body for k in range(len(b))]
    for shard in (10_000, 200, 50):
        got = repeats.repeated_starts(np.frombuffer(b"".join(body), np.uint8), ends, starts, width=8, symbol=2, shard=shard)
        assert got.tolist() == want


def test_op1_merge_counts_and_derives_prefix_lengths(monkeypatch):
    rng = np.random.default_rng(11)
    for step in (1, 2):
        strings = [rng.integers(1, 3, int(n)) for n in rng.integers(1, 12, 40)]
        place_of, at, symbols = [], 0, []
        for s in strings:  # suffixes step apart, the end of each string included
            place_of.append(at + step * np.arange(len(s) + 1))
            wide = np.zeros(step * (len(s) + 1), np.int32)
            wide[: step * len(s) : step] = s
            symbols.append(wide)
            at += len(wide)
        symbols, depth = np.concatenate(symbols), 4
        parts = [repeats.transform(np.concatenate(place_of[k : k + 10]), symbols, step, depth) for k in range(0, 40, 10)]
        with monkeypatch.context() as m:
            for name in ("sort", "argsort", "lexsort", "unique", "partition", "argpartition"):
                m.setattr(np, name, None)
            m.setattr(repeats, "stable_order", None)
            left, right = (repeats.merge(parts[k], parts[k + 1], depth)[0] for k in (0, 2))
            merged, common = repeats.merge(left, right, depth)
        assert sorted(merged.place.tolist()) == sorted(np.concatenate(place_of).tolist())
        suffix = {int(p): s[k:].tolist()[:depth] for s, ps in zip(strings, place_of, strict=True) for k, p in enumerate(ps)}
        rows = [suffix[p] for p in merged.place.tolist()]
        assert rows == sorted(rows)  # a string that ends stands before one that goes on
        alike = lambda x, y: next((k for k, (i, j) in enumerate(zip(x, y, strict=False)) if i != j), min(len(x), len(y)))
        assert common.tolist() == [0] + [alike(x, y) for x, y in zip(rows, rows[1:], strict=False)]
        assert merged.before[merged.follow].tolist() == sorted(merged.before.tolist())


def test_op1_engine_sorts_packed_numbers_in_arrays_that_a_cache_holds(monkeypatch):
    assert 8 * max(repeats.RUN, repeats.SLICE // 2) <= 1 << 20
    rng = np.random.default_rng(7)
    texts = [rng.integers(97, 123, 700).astype(np.uint8) for _ in range(40)]
    buf, ends, starts = np.concatenate(texts + texts[:30]), 700 * np.arange(71), np.full(70, 301)
    sizes, slow = [], []
    for name, seen in (("sort", sizes), ("unique", slow), ("argsort", slow), ("lexsort", slow)):
        monkeypatch.setattr(np, name, lambda x, *a, _real=getattr(np, name), _seen=seen, **k: _seen.append(len(x)) or _real(x, *a, **k))
    got = repeats.repeated_starts(buf, ends, starts)
    inside = np.arange(700) < 301
    assert got.reshape(70, 700).tolist() == [(inside & (k < 30 or k >= 40)).tolist() for k in range(70)]
    assert max(slow, default=0) <= len(ends) and sum(sizes) <= 6 * len(buf)  # symbols, three orders of ranks and one by the symbol before of the strings left, confirmation


def test_op1_runs_of_several_segments_stay_in_their_segments(spark):
    r = np.random.default_rng(8)
    text = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8))
    shared_, other = text(450), text(400)
    rows = [(1, 10, 11, 0, 5, 0, 51, shared_), (1, 10, 12, 0, 7, 0, 61, text(10) + shared_), (2, 20, 21, 0, 0, 0, 1, other), (2, 20, 22, 0, 3, 0, 1, other), (3, 30, 31, 0, 0, 0, 11, text(410))]
    got = repeats._compare(spark.createDataFrame(rows, repeats.SEGMENT)).collect()
    assert sorted(map(tuple, got)) == [(10, 11, 5, 55), (10, 12, 17, 67), (20, 21, 0, 0), (20, 22, 3, 3)]


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_op1_repeated_rows_in_many_parts(spark, group):
    passage = prose(21, 90)
    rows = [(k, prose(300 + k, 60) + passage + prose(400 + k, 40)) for k in range(8)]
    rows += [(k, t) for k, t in rows[:3] for _ in range(9)] + [(None, rows[0][1])] * 5 + [(50, prose(22, 120))]
    seen = Counter(t.encode()[k : k + 400] for _, t in rows for k in range(len(t.encode()) - 399))
    want = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want.append((i, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(17)
    got = [(r.doc_id, r.n_bytes, bytes(r.kept_text)) for r in repeats.removed(docs, group=group).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    ids = defaultdict(list)
    for k, r in enumerate(root):
        ids[r].append(rows[k][0])
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return [(rows[k][0], len(sets[k]), least[r], rows[k][0] == least[r]) for k, r in enumerate(root)]


def test_op2(spark, folder):
    assert rows_of(queries.op2_near_dedup(spark, folder)) == expect(linked(documents()))


def test_op2_links_beyond_the_bucket_head(spark):
    base = prose(30, 300).split()
    rows = []
    for k in range(60):  # neighbours are linked, distant ones are not
        rows.append((k, " ".join([*(f"n{j}" for j in range(4 * k)), *base][: 300])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.clustered(docs).collect()]
    assert expect(got) == expect(linked(rows))


def test_op2_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = np.unique(pool[:2000]), np.unique(pool[300:2300])
    guess, _ = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([2000]), np.array([2000]))
    assert abs(guess[0] - 1700 / 2300) < 0.15
    apart, _ = neardup.estimate(neardup.sketch(a[:1000])[None], neardup.sketch(np.unique(pool[2300:]))[None], np.array([1000]), np.array([700]))
    assert abs(apart[0]) < 0.05


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_op3(spark, folder):
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op3_secret_scan(spark, folder).collect()), key=str)
    want = []
    for r in documents():
        s = base_spans(r[1] or "")
        n = Counter(k for k, _, _ in s)
        want.append((r[0], n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode())))
    assert got == sorted(want, key=str)
    assert [s[0] for s in secrets.find("pwd: x9$Kq27LmZ!p4Rt")] == ["guess"]
    assert secrets.find("pwd: passwordpassword") == []


def test_op3_guess_costs():
    cost = secrets.guess_cost
    assert cost("") == 0
    assert cost("password") < cost("password1987") < cost("x9$Kq27LmZ!p4Rt")
    assert cost("qwertyuiop") < cost("qzwxecrvtb")
    assert cost("aaaaaaaaaaaa") < cost("akfjdhrutowp")
    assert cost("19870412") < cost("98170241")
    assert math.isclose(cost("zq7"), 3.0)


def counts(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(grams)
    inside = {j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_op4(spark, folder):
    got = queries.op4_quality_rules(spark, folder)
    want = []
    for r in documents():
        c = counts(r[1])
        want.append((r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert rows_of(got.drop("kept")) == expect(want)
    assert got.where("base_failed and kept").count() == 0


def test_op4_rejects_what_is_unusual(spark):
    rows = [(k, prose(k, 80), "en", f"s{k % 2}") for k in range(500)]
    rows += [(1000 + k, " ".join(w + "%%%" for w in prose(k, 80).split()), "en", f"s{k % 2}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert kept == set(range(500))


def brute_repair(roles):
    """The least cost by trying all there is to do with each turn: keep 0, merge 1, another role 2, an empty turn before it 3."""
    follow = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    best = {"": 0}
    for r in roles:
        r = (r or "").strip().lower()
        new = defaultdict(lambda: math.inf)
        for last, cost in best.items():
            for role in follow[last]:
                new[role] = min(new[role], cost + (0 if role == r else 2))
                if role != "system":
                    for then in follow[role]:
                        new[then] = min(new[then], cost + 3 + (0 if then == r else 2))
            if last:
                fits = r == last or r not in ("system", "user", "assistant")
                new[last] = min(new[last], cost + (1 if fits else 3))
        best = new
    return min(c + {"assistant": 0, "user": 3, "system": 6}[last] for last, c in best.items())


def test_op5(spark):
    import random

    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "bot", None, "User "]), r.choice(["hi", "", None])) for c in [*range(20), None] for t in range(r.randint(1, 9))]
    rows += [(99, t, r.choice(["user", "assistant", "tool"]), "x") for t in range(500)]  # one conversation over all parts
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for x in chat.repaired(docs).collect():
        got[x.conv_id].append(x)
    assert sum(map(len, got.values())) == len(rows)
    key = lambda x: (x is not None, x)
    for conv, own in got.items():
        own.sort(key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own)))
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[3] or "", key(x[2])))
        assert sum(x.cost for x in own) == brute_repair([x[2] for x in turns])
        roles = re.findall(r"<\|(system|user|assistant)\|>", "".join(x.piece for x in own))
        assert re.fullmatch("(system )?(user assistant )*", "".join(x + " " for x in roles))
    assert chat.repaired(docs.limit(0)).collect() == []


def test_op6(spark, folder):
    got = queries.op6_sharding(spark, folder).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in documents())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op6_keeps_linked_documents_together(spark):
    docs = spark.createDataFrame([(k, f"text {k % 40 if k < 160 else k}") for k in range(2400)], "doc_id long, text string")
    where = defaultdict(set)
    for r in sharding.assign(docs).collect():
        if r.doc_id < 160:
            where[r.doc_id % 40].add(r.shard)
    assert sum(len(s) == 1 for s in where.values()) >= 38


def test_op7(spark):
    items = [(k, prose(500 + k, 30)) for k in range(20)] + [(20, None), (21, ""), (22, "two words")]
    edited = items[3][1].split()
    edited[4:6], edited[15] = ["changed"], "other"
    rows = [(k, prose(k, 300)) for k in range(30)] + [(100, prose(1, 90) + " " + items[2][1].upper() + " " + prose(2, 90)), (101, prose(3, 200) + " " + " ".join(edited)), (102, None), (103, "")]
    rows += [(200 + k, prose(60 + k, 20) + " " + items[5][1]) for k in range(100)]  # a leak into most documents
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, benchmark_hits string")
    got = decontaminate.matched(docs, spark.createDataFrame(items, "item_id long, text string"))
    hits = {r.doc_id: [h.item_id for h in r.benchmark_hits] for r in got.collect()}
    assert {i for i, h in hits.items() if h} == {100, 101, *range(200, 300)}
    assert hits[100] == [2] and hits[101] == [3] and hits[205] == [5]
    none = decontaminate.matched(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where(F.size("benchmark_hits") > 0).count() == 0


def test_op7_alignment():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert decontaminate.align(a, np.array([9, 1, 2, 3, 4, 5, 6, 9])) == (12, 1, 7)
    assert decontaminate.align(a, np.array([1, 2, 3, 9, 4, 5, 6]))[0] == 11
    assert decontaminate.align(a, np.array([7, 8]))[0] == 0


def test_op8(spark, folder):
    tokens = [[*WORD.findall((r[1] or "").translate(LOWER)), None] for r in documents()]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in documents()]
    uni, pair, past = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        for x, w in zip([0, *t[:-1]], t, strict=True):
            if not h:
                uni[w] += 1
                pair[x, w] += 1
                past[x] += 1
    total = sum(uni.values())
    d = [shares(n) for n in (uni, pair)]
    kept = lambda n, k: d[k][n - 1] * n if n <= 5 else n - 0.5
    p = {w: kept(n, 0) / total for w, n in uni.items()}
    unknown = 1 - sum(p.values())
    after = defaultdict(list)
    for (x, w), n in pair.items():
        after[x].append((w, n))
    weight = {x: (1 - sum(kept(n, 1) for _, n in s) / past[x]) / (1 - sum(p[w] for w, _ in s)) for x, s in after.items()}

    def prob(x, w):
        if pair[x, w]:
            return kept(pair[x, w], 1) / past[x]
        return weight.get(x, 1.0) * p.get(w, unknown)

    for x in list(after)[:20]:  # all tokens after a history have a probability of one together
        assert math.isclose(sum(prob(x, w) for w in uni) + weight[x] * unknown, 1.0)
    got = sorted(((r.n_tokens, r.score, r.base_score, r.doc_id, r.held_out, r.n_known, r.train_tokens) for r in queries.op8_katz_backoff(spark, folder).collect()), key=lambda r: (r[0], r[1]))
    want = []
    for r, t, h in zip(documents(), tokens, held, strict=True):
        s = sum(math.log10(prob(x, w)) for x, w in zip([0, *t[:-1]], t, strict=True))
        b = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t)
        want.append((len(t), s, b, r[0], h, sum(w in uni for w in t), total))
    for g, w in zip(got, sorted(want, key=lambda r: (r[0], r[1])), strict=True):
        assert g[0] == w[0] and g[4:] == w[4:]
        assert math.isclose(g[1], w[1], rel_tol=1e-9, abs_tol=1e-6) and math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-6)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path(byte_bpe.RANKS)), special_tokens={})


def test_op9(spark, folder, library):
    want = []
    for r in documents():
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert rows_of(queries.op9_byte_bpe(spark, folder)) == expect(want)


def test_op9_offsets(spark, folder):
    import public_tokenizers

    pieces = byte_bpe.Codec(public_tokenizers.path(byte_bpe.RANKS)).pieces
    for r in byte_bpe.encode_decode(spark.read.parquet(f"{folder}/documents.parquet")).collect():
        raw, at = (r.text or "").encode(), 0
        for i, end in zip(r.token_ids, r.token_ends, strict=True):
            assert raw[at:end] == pieces[i]
            at = end
        assert at == len(raw) and bytes(r.decoded) == raw


def test_op9_boundaries(library):
    import random

    import public_tokenizers

    r = random.Random(7)
    signs = ["'", " ", "\n", "\t", " ", "s", "t", "r", "e", "v", "l", "m", "d", "A", "é", "1", "½", "!", "…", "漢", "😀", "́", "x"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, before = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS)).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, a, b in zip(texts, before[:-1], before[1:], strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(t)
    rank = byte_bpe.ranks(public_tokenizers.path(byte_bpe.RANKS))
    for piece in (b" harbor", b"qwxzz", "漢字".encode(), b"aaaaaaaaaaaaa"):
        assert byte_bpe.merge(piece, rank) == library._core_bpe.encode_single_piece(piece)


def test_op10(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    want, start = [], 0
    got = sorted(queries.op10_token_output(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r in order:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_op10_random_access(spark, folder, tmp_path):
    place = f"file://{tmp_path}/tokens"
    files = token_store.write(spark.read.parquet(f"{folder}/documents.parquet"), place).collect()
    name = next(f.file for f in files if f.first_id is not None and f.first_id <= 105 <= f.last_id)
    one = token_store.File(place, name).find(105)
    assert len(one) == 1 and one[0][-1] == 2


def test_pipeline(spark, write_table, folder):
    import corpus_pipeline

    spark.createDataFrame([(1, prose(3, 40)), (2, prose(900, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert result[8].text == prose(9, 50)  # its other text begins with a benchmark item
    assert 100 in result and not any(i in result for i in range(101, 130))
    assert corpus_pipeline.run(spark, folder).where("text like '%AKIAABC%'").count() == 0


@pytest.mark.parametrize(("heavy", "size"), [(0, 16 << 20), (0, 4000), (10**9, 16 << 20)])
def test_op2_heavy_and_light_buckets_agree(spark, monkeypatch, heavy, size):
    import random

    monkeypatch.setattr(neardup, "HEAVY", heavy)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    r = random.Random(9)
    base = prose(40, 160).split()
    rows = []
    for k in range(50):  # copies with a few edits each: some are linked, most only nearly
        words = list(base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(160)] = f"edit{k}x{r.random()}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.clustered(docs).collect()]
    assert expect(got) == expect(linked(rows))


def test_pipeline_near_dedup_from_80_percent(spark):
    import random

    import corpus_pipeline

    r = random.Random(4)
    rows, between = [], 0
    for k in range(60):  # a text and a copy with some words changed
        base = prose(3000 + k, 200).split()
        words = list(base)
        for j in range(r.randint(2, 6)):
            words[r.randrange(200)] = f"edit{k}x{j}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(words))]
    kept = set()
    for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(x), shingles(y)
        share = len(x & y) / len(x | y)
        between += 0.8 <= share < 0.85
        kept |= {a} if share >= 0.8 else {a, b}
    assert between >= 5 and len(kept) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d.doc_id for d in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept
    assert [neardup.band_rows(p) for p in (85, 80)] == [5, 4]


def test_op7_edited_copies_in_many_documents(spark):
    items = [(k, prose(700 + k, 30)) for k in range(3)]

    def edited(k, *places):
        words = items[k][1].split()
        for j in places:
            words[j] = f"changed{j}"
        return " ".join(words)

    rows = [(k, prose(900 + k, 20) + " " + edited(0, 4, 5, 15)) for k in range(300)]
    # every stretch has an n-gram of a single whole copy, which is rarer than those of the edited ones
    rows += [(1000 + k, prose(1300 + k, 20) + " " + edited(1, 6, 14, 22)) for k in range(300)] + [(2000, items[1][1])]
    rows += [(3000 + k, prose(1700 + k, 50)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.matched(docs, spark.createDataFrame(items, "item_id long, text string"))
    hits = {r.doc_id: [h.item_id for h in r.benchmark_hits] for r in got.collect()}
    assert {i for i, h in hits.items() if h == [0]} == set(range(300))
    assert {i for i, h in hits.items() if h == [1]} == {*range(1000, 1300), 2000}
    assert not any(hits[3000 + k] for k in range(50))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("password: xK7vQ2mT$9rL!4nZ&p8Yw end", "<|secret|> end"),
        ("password: summer2023$extra end", "<|secret|> end"),
        ("token=aaaaaaaa0000 end", "<|secret|> end"),
        ("pwd: x9$Kq!7Zv end", "pwd: <|secret|> end"),
        ("pwd: x9$Kq!7Z end", "pwd: <|secret|> end"),
        ("password: aB3$xY9!q end", "password: <|secret|> end"),
        ("pwd: k7q2x9vz end", "pwd: <|secret|> end"),
        ("pwd: zqxvkwpjr end", "pwd: <|secret|> end"),
        ("the passphrase is required here", "the passphrase is required here"),
        ("pwd: password1987 and pwd: winter2023!", "pwd: password1987 and pwd: winter2023!"),
        ("pwd: 12345678", "pwd: 12345678"),
    ],
)
def test_op3_whole_and_short_values(text, want):
    found = secrets.find(text)
    assert secrets.redact(text, found, "<|secret|>") == want
    assert [s[:3] for s in found if s[0] != "guess"] == base_spans(text)


def test_op10_added_tokens(spark, write_table):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    texts = ["end <|endoftext|> new", "plain words", "x<|startoftext|>Y z<|endoftext|>", "<|endoftext|>", "<|ENDOFTEXT|> <|endof", "text|> after", None, "<|endoftext|><|endoftext|> é漢字", "last one"]
    folder = write_table("documents", [(k, t, "en", "s", 1, "x") for k, t in enumerate(texts)], SCHEMA)
    want, start = [], 0
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert want[0][2:] == (4, zlib.crc32(np.array([806, 49407, 686, 2], "<u4").tobytes()))
    assert rows_of(queries.op10_token_output(spark, folder)) == want


def test_op10_dictionary_sample(spark):
    import public_tokenizers

    docs = [np.arange(k, k + 20_000, dtype="<u4") for k in range(200)]
    slices = [token_store.sample_slice(d) for d in docs]
    assert all(len(x) == token_store.TRAIN_BYTES and x in d.tobytes() for x, d in zip(slices, docs, strict=True))
    where = [int(np.frombuffer(x, "<u4")[0]) - k for k, x in enumerate(slices)]
    assert min(where) < 2000 and max(where) > 17_000
    assert token_store.sample_slice(docs[0][:5]) == docs[0][:5].tobytes()
    rows = [(7, prose(5000 + k % 4500, 12)) for k in range(4600)]  # one id with more texts than are taken
    path = public_tokenizers.path(token_store.TOKENIZER)
    made = {token_store.train_dictionary(spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "text"), 2, path) for n in (2, 7)}
    assert len(made) == 1 and made != {b""}
