"""Language identification: held-out accuracy, cases, and n-grams against plain loops."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from quizmill.llm import langid, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SENTENCES = {
    "en": "the river runs under the old stone bridge and the people walk there every morning with their children",
    "de": "der fluss läuft unter der alten steinbrücke und die menschen gehen dort jeden morgen mit ihren kindern",
    "fr": "la rivière coule sous le vieux pont de pierre et les gens y marchent chaque matin avec leurs enfants",
    "es": "el río corre bajo el viejo puente de piedra y la gente camina allí cada mañana con sus niños",
}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def some(n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = list(SENTENCES)[i % 4]
        rows.append((i, " ".join(rng.choice(SENTENCES[lang].split(), 12)), lang))
    return rows


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op11_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in docs}
    tried = [r for r in docs if held_out(r.doc_id) and r.lang is not None and any(c.isalpha() for c in r.text or "")]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in tried)
    assert len(tried) > 20 and right >= 0.97 * len(tried)
    assert all(got[r.doc_id].held_out == held_out(r.doc_id) and 0 <= got[r.doc_id].score <= 1 for r in docs)


def test_op11_cases(spark, write_table):
    rows = documents()
    folder = write_table("documents", rows, SCHEMA)
    got = queries.op11_language_id(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    learned = {r[2] for r in rows if r[0] is not None and not held_out(r[0]) and r[1] is not None and r[2] is not None}
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in got:
        letter = {any(c.isalpha() for c in t or "") for t in texts[r.doc_id]}
        assert ((r.lang_pred in learned) in letter) and ((r.lang_pred == "und") is (r.score == 0.0) or r.lang_pred != "und")
        if letter == {False}:
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)


def test_prediction_reads_the_text_alone(spark):
    """Other languages, sources and ids beside the same texts change nothing, and neither does the partition."""
    rows = spark.createDataFrame(some(), "doc_id long, text string, lang string")
    model = langid.learn(rows)
    again = langid.learn(rows.repartition(7))
    assert all(np.array_equal(a, b) for a, b in zip(model, again, strict=True))
    texts = [(i, t, "zz", None, 0.5) for i, t, _ in some(60)]
    a = langid.identify(spark.createDataFrame(texts, "doc_id long, text string, lang string, lang_pred string, lang_score double"), model)
    assert a.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_ambiguous"]
    right = {i: lang for i, _, lang in some(60)}
    assert all(r.lang_pred == right[r.doc_id] and not r.lang_ambiguous for r in a.collect())


def test_ambiguous_texts_are_flagged(spark):
    model = langid.learn(spark.createDataFrame(some(), "doc_id long, text string, lang string"))
    words = {lang: s.split() for lang, s in SENTENCES.items()}
    mixed = [" ".join(x for p in zip(words["en"], words["de"], words["fr"], words["es"], strict=False) for x in p), "漢字 かな"]
    got = langid.identify(spark.createDataFrame([(t,) for t in mixed], "text string"), model).collect()
    assert any(r.lang_ambiguous for r in got) and all(r.lang_score < 0.95 for r in got)


def test_a_wrong_bit_is_outvoted():
    """Every codeword decodes to its own language, also with one bit turned, as the code's distance allows."""
    for n in (3, 4, 5, 6, 9, 30):
        words = langid.code(n)
        assert (np.abs(words.astype(int).sum(0)) < n).all() and langid.distance(words) >= (2 if n == 3 else 3)
        model = langid.Model([str(k) for k in range(n)], words, None, np.ones(words.shape[1]), np.zeros(words.shape[1]), np.ones(words.shape[1]))
        for turned in range(-1, min(words.shape[1], 8)):
            margin = words * 3.0
            if turned >= 0:
                margin = margin * np.where(np.arange(words.shape[1]) == turned, -1, 1)
            scores = langid.decoded(margin, model)
            assert np.allclose(scores.sum(1), 1)
            if n > 3 or turned < 0:
                assert (scores.argmax(1) == np.arange(n)).all()


def test_one_language_and_none(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "12 34"), (3, None)], "doc_id long, text string")
    one = langid.learn(spark.createDataFrame([("text", "en"), (None, "de"), ("x", None)], "text string, lang string"))
    assert sorted((r.doc_id, r.lang_pred, r.lang_score) for r in langid.identify(docs, one).collect()) == [(1, "en", 1.0), (2, "und", 0.0), (3, "und", 0.0)]
    none = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert {(r.lang_pred, r.lang_score) for r in langid.identify(docs, none).collect()} == {("und", 0.0)}


def plain_grams(texts):
    """Of each text the number of n-grams of each order: letters in lower case, one blank before, between and behind words."""
    out = []
    for t in texts:
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t)
        words = f" {' '.join(low.split(' '))} " if t else " "
        while "  " in words:
            words = words.replace("  ", " ")
        own = Counter()
        for n in langid.ORDERS:
            own.update(g for g in (words[k : k + n] for k in range(len(words) - n + 1)) if g.strip())
        out.append(own)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abÀß İ1.,\n漢", max_size=30), min_size=1, max_size=5), st.sampled_from([1, 2, 7, 1 << 17]))
def test_grams(texts, piece):
    """As many n-grams as by plain loops, the same bucket for the same n-gram, whatever the pieces."""
    old, langid.PIECE = langid.PIECE, piece
    try:
        found = [Counter() for _ in texts]
        for own, bucket in langid.grams(texts):
            for k, b in zip(own.tolist(), bucket.tolist(), strict=True):
                found[k][b] += 1
    finally:
        langid.PIECE = old
    want = plain_grams(texts)
    assert [sum(c.values()) for c in found] == [sum(c.values()) for c in want]
    assert found == [_by_bucket(c) for c in want]


def _by_bucket(counts):
    """Bucket of each n-gram by the rule, one sign after the other."""
    out = Counter()
    for g, n in counts.items():
        h = len(g)
        for c in g:
            h = ((h ^ (0 if c == " " else ord(c))) * 0x9E3779B97F4A7C15) % 2**64
            h ^= h >> 29
        out[h % langid.BUCKETS] += n
    return out
