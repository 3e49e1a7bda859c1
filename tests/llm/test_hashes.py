"""Words that a weak hash would mix up, in every operator that hashes words."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from cases import SCHEMA, prose

from quizmill.llm import decontaminate, queries, repeats, textvec


def twins(n):
    """The Thue-Morse word over a and b of 2^n letters, and the same with a and b exchanged."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def folder(write_table):
    return write_table("documents", [(k, t, "en", "s", len(t), "x") for k, t in enumerate((*twins(10), *twins(11)))], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_words_keep_apart():
    rng = np.random.default_rng(3)
    raw = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 40, 4000)] + [t.encode() for k in range(12) for t in twins(k)]
    buf = np.frombuffer(b" ".join(raw), np.uint8)
    starts, stops, _ = textvec.words(buf, np.array([0, len(buf)]))
    h = textvec.hashes(buf, starts, stops, False)
    assert len(np.unique(h)) == len(set(raw))
    assert (textvec.hashes(np.frombuffer(b" ".join(raw).upper(), np.uint8), starts, stops, True) == h).all()


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_hash_does_not_depend_on_the_batch(monkeypatch, size):
    monkeypatch.setattr(textvec, "CHUNK", size)
    raw = (prose(1, 200) + " " + "xyz" * 100 + " " + prose(2, 50)).encode()
    buf = np.frombuffer(raw, np.uint8)
    starts, stops, _ = textvec.words(buf, np.array([0, len(buf)]))
    alone = [textvec.hashes(buf[a:b], np.array([0]), np.array([b - a]), False)[0] for a, b in zip(starts, stops, strict=True)]
    monkeypatch.undo()
    assert (textvec.hashes(buf, starts, stops, False) == alone).all()


@pytest.mark.parametrize("bits", [2, 6])
def test_slices_of_one_hash_are_told_apart(monkeypatch, bits):
    real = textvec.hashes
    raw = b" ".join(w.encode() * 8 for w in prose(5, 300).split()) + b" " + b"longer" * 40 + b" " + b"longer" * 40
    buf = np.frombuffer(raw, np.uint8)
    starts, stops, _ = textvec.words(buf, np.array([0, len(buf)]))
    monkeypatch.setattr(textvec, "hashes", lambda *a: real(*a) >> np.uint64(64 - bits))
    cache = textvec.SliceCache(lambda new: [np.array(list(x), np.uint32).tobytes() for x in new])
    ids, each = cache.ids(buf, starts, stops)
    assert bytes(ids.astype(np.uint8)) == raw.replace(b" ", b"") and (each == stops - starts).all()


def test_op1_symbols_of_one_hash(monkeypatch):
    rng = np.random.default_rng(5)
    body = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(8, 40, 30)]
    buf, ends, starts = np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]), np.array([len(b) - 7 for b in body])
    want = repeats.repeated_starts(buf, ends, starts, width=8, symbol=2)
    real = repeats.gram_hashes
    monkeypatch.setattr(repeats, "gram_hashes", lambda *a: real(*a) & np.uint64(1))
    assert (repeats.repeated_starts(buf, ends, starts, width=8, symbol=2) == want).all()


def test_op2(spark, folder):
    got = by_id(queries.op2_near_dedup(spark, folder))
    assert [(got[k].n_shingles, got[k].component_id) for k in range(4)] == [(1, k) for k in range(4)]


def test_op7(spark):
    rows = [(k, f"{prose(50 + k, 20)} {t} {prose(60 + k, 20)}") for k, t in enumerate(twins(10))]
    items = [(7, " ".join([twins(10)[0]] * 12))]
    rows.append((2, f"{prose(70, 20)} {items[0][1]}"))
    found = decontaminate.matched(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: len(r.benchmark_hits) for r in found.collect()} == {0: 0, 1: 0, 2: 1}


def test_op8(spark, folder):
    got = by_id(queries.op8_katz_backoff(spark, folder))
    learned = [k for k in range(4) if zlib.crc32(str(k).encode()) % 7 != 2]
    assert [got[k].n_known for k in range(4)] == [1 + (k in learned) for k in range(4)]
    total, kinds = 2 * len(learned), len(learned) + 1
    for k in range(4):
        want = math.log10(((k in learned) + 1) / (total + kinds + 1)) + math.log10((len(learned) + 1) / (total + kinds + 1))
        assert math.isclose(got[k].base_score, want, abs_tol=1e-6)


def test_op9(spark, folder):
    import public_tokenizers
    import tiktoken

    from quizmill.llm import byte_bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path(byte_bpe.RANKS)), special_tokens={})
    got = by_id(queries.op9_byte_bpe(spark, folder))
    for k, t in enumerate((*twins(10), *twins(11))):
        ids = library.encode_ordinary(t)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op10(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quizmill.llm import token_store

    library = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    got = by_id(queries.op10_token_output(spark, folder))
    for k, t in enumerate((*twins(10), *twins(11))):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
