"""The quality rules and the whole pipeline against plain loops over a table small enough for exact quantiles."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from cases import prose
from test_decontaminate import whole

import corpus_pipeline
from quizmill.llm import byte_bpe, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times = Counter(grams)
    repeated = {j for k, g in enumerate(grams) if times[g] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    kind = [unicodedata.category(c) for c in text]
    blank = " \t\n\x0b\x0c\r"
    n, chars = max(1, len(w)), sum(map(len, w))
    rates = [
        sum(c in "#*$%&|<>" for c in text) / n, kind.count("Lu") / max(1, chars), sum(k[0] not in "LMN" and c not in blank for k, c in zip(kind, text, strict=True)) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)), sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, chars / n,
    ]
    return len(w), len(w) < 10 or 100 * len(repeated) > 20 * len(w), rates


def kept(rows):
    """Which rows pass; small groups are judged by all rows, as every group here is small."""
    found = [measures(r[1]) for r in rows]
    table = np.array([m for n, _, m in found if n >= 10])
    at = lambda q: np.quantile(table, q, axis=0, method="inverted_cdf")
    middle, high = at(0.5), at(0.75)
    out = []
    for n, failed, m in found:
        ok = not failed
        for k, (name, spread, times) in enumerate(quality.FENCES):
            fence = middle[k] + times * max(high[k] - middle[k], spread)
            ok &= m[k] <= fence + quality.ROOM[name == "word_length"] / max(1, n)
        out.append(ok)
    return out


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def table():
    r = random.Random(11)
    items = [(k, prose(8000 + k, 24)) for k in range(6)]
    rows = [(k, prose(k, r.randint(40, 90))) for k in range(110)]
    rows += [(200 + k, rows[k][1]) for k in range(8)]  # exact copies
    for k in range(16):  # near copies, some below the threshold
        words = rows[20 + k][1].split()
        for _ in range(1 + k % 4):
            words[r.randrange(len(words))] = f"edit{k}"
        rows.append((300 + k, " ".join(words)))
    rows += [(400 + k, f"{prose(900 + k, 30)} {t} {prose(950 + k, 20)}") for k, t in items]
    rows += [(500, f"{prose(70, 40)} password: xK7vQ2mT$9rL and token = abcdefgh123"), (501, "too short"), (502, "spam spam spam spam spam " * 20), (503, " ".join(w + "%%%" for w in prose(5, 60).split())), (504, None), (505, "")]
    rows.append(rows[3])  # a row twice
    return [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], items


def test_kept_by_plain_quantiles(spark):
    rows, _ = table()
    got = sorted((r.doc_id, r.kept) for r in quality.judged(spark.createDataFrame(rows, PLAIN)).collect())
    want = sorted((r[0], k) for r, k in zip(rows, kept(rows), strict=True))
    assert got == want and {i for i, k in want if not k} >= {501, 502, 503, 504, 505}


def test_pipeline_by_plain_loops(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    rows, items = table()
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, PLAIN).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = [r for r, k in zip(rows, kept(rows), strict=True) if k]
    sets = [shingles(r[1]) for r in now]
    root = list(range(len(now)))
    between = 0
    for a in range(len(now)):
        for b in range(a):
            share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            between += 0.8 <= share < 1
            if share >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if q in (x, y) else q for q in root]
    groups = defaultdict(list)
    for k, q in enumerate(root):
        groups[q].append(now[k])
    now = [min(g, key=lambda r: r[0]) for g in groups.values()]
    assert between >= 5 and len(now) < len(root)
    clean = [r for r in now if all(whole(t, r[1]) < 0.4 for _, t in items)]
    assert {r[0] for r in now} - {r[0] for r in clean} == {400 + k for k in range(6)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path(byte_bpe.RANKS)), special_tokens={})
    want = {}
    for i, t, *_ in clean:
        t = secrets.redact(t, secrets.find(t), "<|secret|>")
        want[i] = (t, library.encode_ordinary(t))
    assert want[500][0].endswith("<|secret|> and <|secret|>")
    got = {r.doc_id: (r.text, list(r.token_ids)) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
