"""Secrets in texts: fixed patterns, and values in credential context that would be hard to guess.

The guess cost of a value is the least sum, over all ways to cut it into segments, of the decimal
logarithms of the guesses that each segment takes: a word by its rank, a date by the days of
a century, a repeat by its unit, a walk over neighbouring keys or a run of successive
characters by its kind, each with a little for every character, anything else by brute force; each further
segment costs extra. Brute force takes as many guesses a character as the kinds of characters in a value in
credential context have signs. Words are some common passwords, then the whole words of a public tokenizer's
vocabulary in its order, some 32,000; every part of a value is looked up.

A value that is a name costs what its hardest word does, and a little for each further one: words between signs, as in an address, a path, an identifier or
a placeholder, all of which are in the vocabularies of two public tokenizers, many languages among them, or spelled like the words there. A value
that has reached enough guesses after PREFIX characters is not read on; no value of that length can stay below.

Places count code points, ends are exclusive. A null or empty text has no spans. The work grows with the
text's length, however many spans it has.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import math
import re
import unicodedata

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm import shared

SLICE = 1 << 20
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What announces a credential beyond the fixed patterns, and the value after it.
CONTEXT = re.compile(r"""(?<![A-Za-z])(pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\x20-]?key|(?:access|private|client|signing)[_\x20-]?(?:key|secret)|credentials?|bearer|auth(?:orization)?)["']?\x20*(?::|=>|=|\x20is\x20)\x20*(?:bearer\x20|basic\x20)?(["'`]?)([^\s"'`<>,;]{8,})""", re.ASCII | re.IGNORECASE)
MARKS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
#: From so many guesses on, as a power of ten, a value in credential context counts as a secret.
HARD = 10.0

# Common password words in order of use: fixed values
COMMON = "password qwerty admin welcome login letmein monkey dragon master hello freedom whatever trustno princess sunshine shadow football baseball superman batman michael jordan charlie jessica ashley summer winter spring autumn secret default root user test guest changeme example sample token public private access server database system manager office company google apple love money happy world house family computer internet".split()
#: A tokenizer's file whose vocabulary ranks words: those of three letters or more that end a word there.
VOCABULARY, WORD_END = "word_bpe_49k.json", "</w>"
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {a + b for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
LEET = str.maketrans("@4301$57!", "aaeoisst" + "i")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
SEGMENT = math.log10(4)
BRUTE = 1.0
#: What each character of a walk, run or repeat costs, and the least characters of one.
STEP, LEAST = 0.02, 3
WALK, RUN = math.log10(len(NEXT)), 1.0
ALPHABETS = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[ -/:-@\\[-`{-~]"), 33), (re.compile(r"[^\x00-\x7F]"), 100))
#: Words of many languages: the pieces of a byte-level vocabulary that follow a blank.
MANY = "byte_bpe_multi_50k.tiktoken"
#: What a further word of a name costs, the share of a name's letters that stands in words, and the letters from which what is spelled like a word is one.
FURTHER, WORDS_SHARE, SPELLED = 0.5, 2 / 3, 4
#: Of how many words a run of three letters must be part, for a word to be spelled like them.
COMMON_RUN = 3
#: Characters after which a value that has enough guesses is not read on.
PREFIX = 1024
PIECE = re.compile(r"[^\W\d_]+|\d+")
#: What may be a plain word of a sentence.
WORD = re.compile("[A-Za-z]?[a-z]+", re.ASCII)


def sign_cost(value: str) -> float:
    """The decimal logarithm of the number of signs that the value's kinds of characters have together."""
    return max(BRUTE, math.log10(max(1, sum(n for kind, n in ALPHABETS if kind.search(value)))))


@functools.cache
def ranks(path: str | None = None) -> dict[str, int]:
    """The number of guesses after which each word comes up."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    listed = (w.removesuffix(WORD_END) for w in sorted(vocabulary, key=vocabulary.get) if w.endswith(WORD_END))
    words = dict.fromkeys([*COMMON, *(w for w in listed if len(w) >= LEAST and w.isascii() and w.isalpha())])
    return {w: k + 2 for k, w in enumerate(words)}


def plain_letters(word: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


@functools.cache
def spelling() -> tuple[frozenset[str], frozenset[str]]:
    """Words of the two vocabularies, and the runs of three signs, with the word's ends, that several words have."""
    words = set(ranks())
    with open(public_tokenizers.path(MANY), "rb") as f:
        for line in f:
            piece = base64.b64decode(line.split()[0])
            if piece.startswith(b" "):
                word = piece[1:].decode("utf-8", "ignore").lower()
                if len(word) >= LEAST and word.isalpha():
                    words.add(plain_letters(word))
    count: dict[str, int] = {}
    for w in words:
        for run in {f" {w} "[k : k + 3] for k in range(len(w))}:
            count[run] = count.get(run, 0) + 1
    return frozenset(words), frozenset(r for r, n in count.items() if n >= COMMON_RUN)


def name_cost(value: str) -> float:
    """The decimal logarithm of the guesses that a name takes; infinite for what is none.

    A name has signs or changes of case between its pieces, and each piece is a word, two words in one, spelled like a word, a number of up to
    four digits or one or two letters; words make up most of it."""
    pieces = PIECE.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))
    if len(pieces) < 2 and (not pieces or len(pieces[0]) == len(value)):
        return math.inf
    known, runs = spelling()
    rank = ranks()
    costs, letters = [], 0
    for piece in map(plain_letters, pieces):
        if piece.isdecimal():
            if len(piece) > 4:
                return math.inf
            costs.append(len(piece) * BRUTE)
        elif len(piece) >= LEAST and piece in known:
            costs.append(math.log10(rank.get(piece, len(rank))))
            letters += len(piece)
        elif any(piece[:k] in known and piece[k:] in known for k in range(LEAST, len(piece) - LEAST + 1)):
            costs.append(math.log10(len(rank)))
            letters += len(piece)
        elif len(piece) >= SPELLED and all(f"{piece} "[k : k + 3] in runs for k in range(len(piece) - 1)):
            costs.append(math.log10(len(rank)) + BRUTE)
            letters += len(piece)
        elif len(piece) <= 2:
            costs.append(len(piece) * math.log10(26))
        else:
            return math.inf
    if letters < WORDS_SHARE * sum(map(len, pieces)):
        return math.inf
    return max(costs) + FURTHER * (len(costs) - 1)


@functools.cache
def longest(path: str | None = None) -> int:
    return max(map(len, ranks(path)))


def fixed_segments(value: str, path: str | None = None):
    """(start, end, cost) of each word and date in the value, overlapping ones too."""
    plain, rank, most = value.lower(), ranks(path), longest(path)
    if len(plain) != len(value):  # a few letters have two signs in lower case
        plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    leet, n = plain.translate(LEET), len(value)
    for i in range(n):
        for j in range(i + LEAST, min(n, i + most) + 1):
            r = rank.get(plain[i:j]) or 2 * rank.get(leet[i:j], 0)
            if r:
                yield i, j, math.log10(r * (1 if plain[i:j] == value[i:j] else 2))
    for i in range(n):
        if (m := DATE.match(value, i)) and m.end() - i >= 4:
            yield i, m.end(), math.log10(100 if m.end() - i == 4 else 36_500)
            if m.end() - i > 4 and value[i : i + 2] in ("19", "20") and value[i : i + 4].isdecimal():
                yield i, i + 4, math.log10(100)


def patterns(value: str, brute: float) -> list[tuple[float, int, list[int]]]:
    """For walks, ascending and descending runs, and repeats of one to four signs: what one costs to begin, its least length, and the length of the longest that ends after each character."""
    plain, n = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in value], len(value)
    pairs = [chr(a) + chr(b) in NEXT for a, b in zip(plain, plain[1:], strict=False)]
    kinds = [(WALK, LEAST, 1, pairs)]
    kinds += [(RUN, LEAST, 1, [b - a == d for a, b in zip(plain, plain[1:], strict=False)]) for d in (1, -1)]
    kinds += [(brute * w, max(LEAST, 2 * w), w, [a == b for a, b in zip(value, value[w:], strict=False)]) for w in (1, 2, 3, 4)]
    out = []
    for begin, least, width, goes_on in kinds:
        length = [min(k + 1, width) for k in range(n)]
        for k in range(width, n):
            if goes_on[k - width]:
                length[k] = length[k - 1] + 1
        out.append((begin, least, length))
    return out


def guess_cost(value: str, sign: float = BRUTE, path: str | None = None, enough: float = math.inf) -> float:
    """The decimal logarithm of the guesses that the cheapest segmentation takes, ``sign`` for each character by brute force; 0 for an empty value.

    Of a value longer than PREFIX the least that any way over its beginning costs, if that is ``enough``."""
    if len(value) > PREFIX and enough < math.inf and (least := _cost(value[:PREFIX], sign, path, True)) >= enough:
        return least
    return _cost(value, sign, path, False)


@functools.lru_cache(4096)
def _cost(value: str, sign: float, path: str | None, goes_on: bool) -> float:
    """The cost of the cheapest segmentation, or of the beginning of a value that goes on: no segmentation of the whole costs less.

    Every part of a walk, run or repeat counts as one too: for each kind the cheapest cost with such
    a segment up to a character comes from that up to the character before, or from a new shortest one."""
    n = len(value)
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in fixed_segments(value, path):
        ends.setdefault(j, []).append((i, cost))
    kinds = patterns(value, sign)
    inside = [math.inf] * len(kinds)
    brute, other = [math.inf] * (n + 1), [math.inf] * (n + 1)  # the last segment is brute force, or another
    other[0] = -SEGMENT
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], other[j - 1] + SEGMENT) + sign
        for i, cost in ends.get(j, ()):
            other[j] = min(other[j], min(brute[i], other[i]) + SEGMENT + cost)
        for k, (begin, least, length) in enumerate(kinds):
            if length[j - 1] < least:
                inside[k] = math.inf
                continue
            i = j - least
            inside[k] = min(inside[k] + STEP, min(brute[i], other[i]) + SEGMENT + begin + STEP * least)
            other[j] = min(other[j], inside[k])
    if goes_on:  # whatever segment lies over the cut began after one of the last places, or is a pattern that goes on
        back = max(longest(path), *(least for _, least, _ in kinds), 10)  # a date has ten signs
        return max(0.0, min(*inside, *brute[max(0, n - back) :], *other[max(0, n - back) :]))
    return max(0.0, min(brute[n], other[n])) if n else 0.0


class Cover:
    """What spans cover together: runs that neither meet nor overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def whole(self, a: int, b: int) -> bool:
        """Whether all from a up to b is covered."""
        k = bisect.bisect_right(self.starts, a) - 1
        return a >= b or (k >= 0 and b <= self.ends[k])

    def part(self, a: int, b: int) -> bool:
        """Whether something from a up to b is covered."""
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, guesses) in order of start, then of KINDS. guesses: for a value found by its cost that cost, for others one sign of brute force a character."""
    out = [("hex", m.start(), m.end(), BRUTE * (m.end() - m.start())) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), BRUTE * (m.end() - m.start())) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    low = text.lower()
    if any(x in low for x in MARKS):
        out += [("assign", m.start(), m.end(), BRUTE * len(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        base = Cover([(a, b) for _, a, b, _ in out])
        for m in CONTEXT.finditer(text):
            a, b = m.span(3)
            if base.whole(a, b):
                continue
            value = m[3].rstrip(".!?)")
            part, name = base.part(a, b), len(m[3]) <= PREFIX and name_cost(m[3]) < HARD
            if name and not (part and re.search("[0-9]", value)):  # words and a number, of which the fixed patterns took a part, may well be a password
                continue
            if part:
                if not base.whole(a, a + len(value)):  # a value of which the fixed patterns name a part is a secret to its end
                    out.append(("guess", a, b, BRUTE * len(value)))
                continue
            # after "is", what looks like a word of the sentence is not taken for random letters
            prose = " is " in text[m.start() : a].lower() and WORD.fullmatch(value)
            cost = guess_cost(value, BRUTE if prose else sign_cost(value), enough=HARD)
            if cost >= HARD:
                out.append(("guess", a, b, cost))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int, float]], mark: str) -> str:
    """The text with each maximal union of spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("guesses", T.DoubleType())]), False)


def scan(docs: DataFrame, mark: str | None = None) -> DataFrame:
    """Add ``secret_spans`` (array of kind, start, end, guesses) to every row; with ``mark``, also
    ``redacted_text``: the text with ``mark`` in place of every span.

    Every row gives one row, repeated ones too; a null text has no spans and stays null. Input columns
    of the added names are replaced, others stay.
    """
    shared.shared_dir(docs.sparkSession)
    new = ("secret_spans", *(["redacted_text"] if mark is not None else []))
    return shared.aside(docs, ("text",), lambda rows: _scanned(rows, mark, new), new)


def _scanned(docs: DataFrame, mark: str | None, new: tuple[str, ...]) -> DataFrame:
    base = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*base.schema.fields, T.StructField("secret_spans", SPAN, False), *([T.StructField("redacted_text", T.StringType())] if mark is not None else [])])
    names = [*base.columns, *new]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))

    def run(batches):
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = part.column("text").to_pylist()
                found = [find(t) if t else [] for t in texts]
                made = {"secret_spans": pa.array([[dict(zip(("kind", "start", "end", "guesses"), s, strict=True)) for s in f] for f in found], arrow)}
                if mark is not None:
                    made["redacted_text"] = pa.array([t if t is None else redact(t, f, mark) for t, f in zip(texts, found, strict=True)], pa.string())
                yield shared.with_columns(part, made, names)

    return base.mapInArrow(run, schema)
