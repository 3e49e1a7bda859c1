"""Guess costs against every segmentation, spans against a plain search, and long texts."""

import itertools
import math
import random
import re
import time
from functools import cache

import pytest

from quizmill.llm import secrets

DATE = re.compile(r"(19|20)\d\d([-/.]?(0[1-9]|1[0-2])[-/.]?(0[1-9]|[12]\d|3[01]))?|(0[1-9]|[12]\d|3[01])[-/.]?(0[1-9]|1[0-2])[-/.]?(19|20)\d\d")


def one(part, brute):
    """The least cost of a part as a single segment, brute force left out."""
    low, rank = part.lower(), secrets.ranks()
    plain = low.translate(str.maketrans("@4301$57!", "aaeoissti"))
    best = [math.inf]
    if low in rank:
        best.append(math.log10(rank[low] * (2 if low != part else 1)))
    elif plain in rank:
        best.append(math.log10(2 * rank[plain] * (2 if low != part else 1)))
    if DATE.fullmatch(part):
        best.append(2.0 if len(part) == 4 else math.log10(36500))
    if len(part) >= 3:
        pairs = list(itertools.pairwise(low))
        if all(any(a + b in row or b + a in row for row in ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")) for a, b in pairs):
            best.append(math.log10(2 * (12 + 11 + 10 + 9)) + 0.02 * len(part))
        if all(ord(b) - ord(a) == 1 for a, b in pairs) or all(ord(b) - ord(a) == -1 for a, b in pairs):
            best.append(1 + 0.02 * len(part))
        for w in range(1, 5):
            if len(part) >= 2 * w and all(part[k] == part[k - w] for k in range(w, len(part))):
                best.append(brute * w + 0.02 * len(part))
    return min(best)


def cheapest(value, brute):
    @cache
    def of(i, after_brute):
        if i == len(value):
            return 0.0
        more = 0.0 if i == 0 else math.log10(4)
        costs = [brute + of(i + 1, True) + (0.0 if after_brute else more)]
        costs += [more + c + of(j, False) for j in range(i + 3, len(value) + 1) if (c := one(value[i:j], brute)) < math.inf]
        return min(costs)

    return of(0, False)


@pytest.mark.parametrize("seed", range(6))
def test_least_cost_over_all_segmentations(seed):
    r = random.Random(seed)
    parts = ["qwert", "asd", "123", "4321", "abc", "aaa", "xyxy", "1987", "19870412", "12/04/1987", "password", "P4ssw0rd", "elephant", "garden", "Dragon", "x", "Q", "9", "!", "zq", "poi", "hgf"]
    for _ in range(120):
        value = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))[: r.randint(1, 18)]
        for brute in (1.0, 1.9):
            assert math.isclose(secrets.guess_cost(value, brute), cheapest(value, brute), abs_tol=1e-9), value


@pytest.mark.parametrize("value", ["elephantgarden", "ElephantGarden", "gardenbattery1", "dragon1987", "qwertyuiop123", "summersummer", "abcdefgh12345"])
def test_words_are_guessed(value):
    assert secrets.guess_cost(value, secrets.sign_cost(value)) < secrets.HARD
    assert secrets.find(f"pwd: {value}") == []


@pytest.mark.parametrize("value", ["xK7vQ2mT9r", "zqxvkwpjrt", "k7q2x9vzp4"])
def test_random_values_are_not(value):
    assert secrets.guess_cost(value, secrets.sign_cost(value)) >= secrets.HARD
    assert [s[0] for s in secrets.find(f"pwd: {value}")] == ["guess"]


def test_cover():
    r = random.Random(1)
    for _ in range(500):
        spans = [(a, a + r.randint(1, 4)) for a in (r.randint(0, 20) for _ in range(r.randint(0, 6)))]
        cover, full = secrets.Cover(spans), {k for a, b in spans for k in range(a, b)}
        a = r.randint(0, 20)
        b = a + r.randint(1, 6)
        assert cover.whole(a, b) == (set(range(a, b)) <= full)
        assert cover.part(a, b) == bool(set(range(a, b)) & full)


def test_long_texts():
    lines = "".join(f"password: aB3$xY9!q{k}\ntoken = tok{k:08d}\n" for k in range(20_000))
    began = time.process_time()
    found = secrets.find(lines)
    assert time.process_time() - began < 30
    assert len(found) == 40_000 and sum(s[0] == "assign" for s in found) == 20_000
    one_value = "pwd: " + "Zq7$" * 20_000
    assert [s[0] for s in secrets.find(one_value)] == ["guess"]


@pytest.mark.parametrize(
    "text",
    [
        "authorization: https://example.com/path/to/page", "pwd: ${DB_PASSWORD}", "token: {placeholder_value}", "credentials: user.name@example.com", "auth: Authentication_method_used",
        "pwd: Passwort-vergessen-Link", "secret = contraseña-olvidada", "auth: getUserSessionFromRequest", "credentials: mot-de-passe-oublié", "bearer: [your-access-token-here]",
    ],
)
def test_names_are_left(text):
    """Addresses, paths, identifiers and placeholders, in several languages; what the fixed patterns find stays theirs."""
    assert [s for s in secrets.find(text) if s[0] == "guess"] == []


def test_random_values_between_signs_are_found():
    """Of 4,000 random values with separators, of letters, digits or both, nearly all are found; names of three words of a vocabulary are left."""
    r, missed, total = random.Random(5), 0, 0
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_./"):
        for _ in range(1000):
            value = r.choice("-_./").join("".join(r.choice(alphabet) for _ in range(r.randint(4, 8))) for _ in range(3))
            total += 1
            missed += [s[0] for s in secrets.find(f"pwd: {value}")] != ["guess"]
    assert missed <= 0.01 * total
    words = sorted(w for w in secrets.ranks() if 4 <= len(w) <= 8)
    names = ["-".join(r.choice(words) for _ in range(3)) for _ in range(300)]
    assert sum(bool(secrets.find(f"pwd: {n}")) for n in names) <= 3


@pytest.mark.parametrize("value", ["Zq7$" * 250_000, "a" * 1_000_000, "correct horse".replace(" ", "") * 80_000, "".join(map(str, range(150_000)))[:1_000_000]])
def test_a_million_characters_take_no_time(value):
    began = time.process_time()
    hexadecimal = set(value) <= set("0123456789abcdef")
    assert [s[0] for s in secrets.find(f"pwd: {value}")] == ["hex" if hexadecimal else "guess"]
    assert secrets.find(f"token={value}")
    assert time.process_time() - began < 3


@pytest.mark.parametrize("seed", range(4))
def test_the_beginning_bounds_the_whole(seed):
    """What the beginning costs at least, no segmentation of the whole undercuts."""
    r = random.Random(seed)
    parts = ["qwert", "123", "abc", "aaa", "xyxy", "1987", "19870412", "password", "elephant", "garden", "x", "Q", "9", "zq"]
    for _ in range(60):
        value = "".join(r.choice(parts) for _ in range(r.randint(2, 9)))
        for cut in range(1, len(value)):
            assert secrets._cost(value[:cut], 1.9, None, True) <= secrets._cost(value, 1.9, None, False) + 1e-9
