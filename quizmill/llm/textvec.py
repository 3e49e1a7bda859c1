"""Words, hashes and lookups over many texts at once, on byte arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes have 64 bits. Up to seven bytes and their number are
the 64 bits themselves, mixed by a bijection, so two short words never share a hash. Of longer words each
eight bytes are mixed with a key of their place before they are added up, so no arithmetic of the sum
makes structured words meet; two of them share a hash with a chance of 2^-64. ``SliceCache`` compares
the bytes besides, so there a shared hash changes nothing.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240611)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MULTS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
CHUNK = 1 << 20
#: Of the eight bytes from a slice's place on, those that are the slice's, by their number.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each bit of the argument reaches each bit of the result."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (one entry more than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    in_word = ~BLANK[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0], edge[-1] = in_word[0], in_word[-1]
    np.not_equal(in_word[1:], in_word[:-1], out=edge[1:-1])
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    glued = inner[in_word[inner] & in_word[inner - 1]]  # a word that would run on into the next text
    at = np.flatnonzero(edge)
    if len(glued):
        both = np.unique(glued)
        at = np.sort(np.concatenate([at, both, both]), kind="stable")
    starts, stops = at[::2], at[1::2]
    return starts, stops, np.searchsorted(starts, ends, "left")


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[:-8] = buf
    return np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))


def _of_long(lane: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of slices of eight bytes or more: their lanes, one slice after the other, each lane's place in its slice, and each slice's first lane."""
    n = (stops - starts + 7) // 8
    first = np.cumsum(n) - n
    nth = np.arange(int(n.sum())) - np.repeat(first, n)
    x = lane[np.repeat(starts, n) + 8 * nth]
    last = first + n - 1
    x[last] &= _OWN[(stops - starts) - 8 * (n - 1)]
    return x, nth, first


def hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool) -> np.ndarray:
    """The hash of each slice; ``fold`` takes A-Z as a-z. Slices ascend."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + CHUNK, "right")))
        lo, hi = int(starts[a]), int(stops[b - 1])
        if hi - lo > CHUNK:  # one long slice, a piece of whole lanes at a time
            pieces = [_sum(buf[x : min(x + CHUNK, hi)], (x - lo) // 8, fold) for x in range(lo, hi, CHUNK)]
            out[a:b] = _joined(np.array([pieces], np.uint64).sum(1, dtype=np.uint64), np.array([hi - lo], np.uint64))
            a = b
            continue
        lane = lanes(_LOWER[buf[lo:hi]] if fold else buf[lo:hi])
        s, n = starts[a:b] - lo, stops[a:b] - starts[a:b]
        own = mix((lane[s] & _OWN[np.minimum(n, 7)]) | (n.astype(np.uint64) << U(56)))
        long = np.flatnonzero(n > 7)
        if len(long):
            x, nth, first = _of_long(lane, s[long], s[long] + n[long])
            own[long] = _joined(np.add.reduceat(mix(x ^ _place_keys(nth)), first), n[long].astype(np.uint64))
        out[a:b] = own
        a = b
    return out


_keys = [mix(np.arange(1, 4097, dtype=np.uint64) * U(0x9E3779B97F4A7C15))]


def _place_keys(nth: np.ndarray) -> np.ndarray:
    """A number for each place of a lane in its slice."""
    if len(nth) and int(nth.max()) >= len(_keys[0]):
        return mix((nth.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    return _keys[0][nth]


def _sum(part: np.ndarray, place: int, fold: bool) -> np.uint64:
    """What a piece of a long slice adds to its sum."""
    x, nth, _ = _of_long(lanes(_LOWER[part] if fold else part), np.array([0]), np.array([len(part)]))
    return mix(x ^ _place_keys(nth + place)).sum(dtype=np.uint64)


def _joined(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(total ^ (n * U(0xA0761D6478BD642F)))


def grams(word: np.ndarray, before: np.ndarray, n: int, taken: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of n words that lies in one text, and the index of its first word. ``taken``: the places that count, all if not given."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n) if taken is None else taken:
        total += word[k : len(word) - n + 1 + k] * _MULTS[k]
    ok = np.ones(len(total), bool)
    cuts = before[1:-1]
    for k in range(1, n):  # a window that begins less than n words before the end of its text
        x = cuts - k
        ok[x[(x >= 0) & (x < len(ok))]] = False
    first = np.flatnonzero(ok)
    return mix(total[first]), first


def sequence_hash(word: np.ndarray) -> np.uint64:
    """Of a whole sequence of words, however long."""
    x = U(len(word))
    with np.errstate(over="ignore"):
        for w in word:
            x = mix(np.array([x * _MULTS[0] + w * _MULTS[1]]))[0]
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each of the given runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def classes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first slice of each class of equal ones, and the class of each slice. Slices of one hash are compared byte by byte."""
    _, first, back = np.unique(hashes(buf, starts, stops, False), return_index=True, return_inverse=True)
    n, head = stops - starts, first[back]
    other = n != n[head]
    at = np.flatnonzero((n > 7) & (head != np.arange(len(head))) & ~other)  # shorter ones of one hash are equal
    a, lane = 0, lanes(buf)
    while a < len(at):
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(n[at[a : a + CHUNK]]), CHUNK, "right")))
        some = at[a:b]
        x, _, cut = _of_long(lane, starts[some], stops[some])
        y, _, _ = _of_long(lane, starts[head[some]], stops[head[some]])
        other[some] = np.add.reduceat((x != y).astype(np.int64), cut) > 0
        a = b
    wrong = np.flatnonzero(other)
    if len(wrong):
        more: dict[bytes, int] = {}
        heads = [*first.tolist()]
        for k in wrong.tolist():
            key = buf[starts[k] : stops[k]].tobytes()
            if key not in more:
                more[key] = len(heads)
                heads.append(k)
            back[k] = more[key]
        first = np.array(heads)
    return first, back


class SliceCache:
    """From slices of bytes to ids, each different slice computed once while it is kept.

    ``compute`` takes a list of bytes objects and returns the ids of each as the bytes of 32-bit integers. The cache holds
    at most ``most`` slices; beyond that it starts anew, which costs time and never changes ids.
    """

    def __init__(self, compute, most: int = 800_000):
        self.compute, self.most, self.known = compute, most, {}

    def ids(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each slice."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, back = classes(buf, starts, stops)
        raw = buf.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        known = self.known
        new = [k for k in keys if k not in known]
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = keys
            for k, v in zip(new, self.compute(new), strict=True):
                known[k] = v
        got = [known[k] for k in keys]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        at = np.cumsum(sizes) - sizes
        each = sizes[back]
        return flat[ragged(at[back], each)], each
