"""Byte-level BPE encoding and decoding without a regex.

Each code point gets a class from a table. A finite automaton over these classes knows at each
character whether a new slice begins. Its transition functions compose associatively, so the
states of a whole batch come from a scan: blocks of characters are composed side by side, the
block functions are combined by doubling, and each block is run again from its true entry state.
Slices go through pair merging by rank, with a cache.

Empty and null texts have no ids. Ids, and the byte at which each ends, are kept, so any
range of ids can be decoded and placed in the text.
"""

from __future__ import annotations

import base64
import functools
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm import shared
from quizmill.llm.textvec import SliceCache

RANKS = "byte_bpe_50k.tiktoken"
SLICE = 1 << 20
BLOCK = 128

# Classes of characters; the second eight are the same at the start of a text.
LETTER, ENDS, LEADS, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(8)
# States: what the last character was a part of.
BEGIN, IN_L, IN_N, IN_O, IN_SPACE, IN_WHITE, AT_QUOTE, MIDDLE, DONE = range(9)


@functools.cache
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE, WHITE or QUOTE for each code point.

    Which code points are letters and numbers depends on the Unicode version; the table takes that of
    the tiktoken library, by asking it whether the code point stands in one slice with ``a`` or ``1``.
    """
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0x80, 0xD800), *range(0xE000, 0x110000)]
    for kind, sign in ((LETTER, "a"), (NUMBER, "1")):
        own = {bytes([i]): i for i in range(256)} | {sign.encode() + bytes([i]): 128 + i for i in range(0x80, 0x100)} | {bytes([i]) + b"\xff\xff": 400 + i for i in range(128)}
        ids = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary("\n".join(sign + chr(c) for c in points))
        ids = np.array(ids)
        at = np.flatnonzero((ids == ord(sign)) | ((ids >= 256) & (ids < 400)))
        out[np.array(points)[ids[at] >= 256]] = kind
    for low, high, kind in (("a", "z", LETTER), ("A", "Z", LETTER), ("0", "9", NUMBER)):
        out[ord(low) : ord(high) + 1] = kind
    # White_Space of Unicode: fixed values
    out[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a slice begins before the character, by (class, state)."""
    move, cut = np.zeros((16, 16), np.uint8), np.zeros((16, 16), bool)
    for kind in range(8):
        for state in range(9):
            begins = True
            if kind in (LETTER, ENDS, LEADS):
                to = IN_L
                if state in (IN_L, IN_SPACE):
                    begins = False
                elif state == AT_QUOTE and kind != LETTER:
                    to, begins = (DONE if kind == ENDS else MIDDLE), False
                elif state == MIDDLE:
                    to, begins = DONE, False
            elif kind == NUMBER:
                to, begins = IN_N, state not in (IN_N, IN_SPACE)
            elif kind == OTHER:
                to, begins = IN_O, state not in (IN_O, IN_SPACE, AT_QUOTE)
            elif kind == QUOTE:
                begins = state not in (IN_O, IN_SPACE, AT_QUOTE)
                to = AT_QUOTE if begins else IN_O
            else:
                to, begins = (IN_SPACE if kind == SPACE else IN_WHITE), state not in (IN_SPACE, IN_WHITE)
            move[kind, state], cut[kind, state] = to, begins
        move[kind + 8, :], cut[kind + 8, :] = move[kind, BEGIN], True
    return move, cut


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The state in which the automaton meets each symbol: an inclusive scan of function composition, shifted by one."""
    move = automaton()[0]
    n = len(symbols)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, LETTER, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat = move.ravel()
    whole = np.broadcast_to(np.arange(9, dtype=np.uint8), (rows, 9))
    for k in range(BLOCK):  # the function of each block
        whole = flat[(grid[k].astype(np.uint16) << 4)[:, None] + whole]
    step = 1
    while step < rows:  # the function of all blocks up to each one
        joined = whole.copy()
        joined[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)
        whole, step = joined, step * 2
    now = np.zeros(rows, np.uint8)
    now[1:] = whole[:-1, BEGIN]
    out = np.empty((BLOCK, rows), np.uint8)
    for k in range(BLOCK):
        out[k] = now
        now = flat[(grid[k].astype(np.uint16) << 4) + now]
    return out.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the first character of each slice. ``first``: index of the first character of each text."""
    if not len(points):
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    later = np.zeros(len(points), points.dtype)
    later[:-1] = points[1:]
    last = np.zeros(len(points), bool)
    last[first[1:] - 1] = True
    last[-1] = True
    later[last] = 0
    symbols = kind.copy()
    for c in "stmd":
        symbols[points == ord(c)] = ENDS
    for a, b in (("r", "e"), ("v", "e"), ("l", "l")):
        symbols[(points == ord(a)) & (later == ord(b))] = LEADS
    symbols[first] += 8
    state = states_before(symbols)
    begins = automaton()[1][symbols, state]
    white = kind >= SPACE
    before_word = np.zeros(len(points), bool)
    before_word[:-1] = ~white[1:]
    before_word[last] = False
    return np.flatnonzero(begins | (white & before_word))  # the last blank before a word stands for itself or belongs to it


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Join the neighbouring pair of lowest rank, the leftmost first, until no pair has a rank.

    The plain form of what ``Codec`` has the library's merge loop do for a slice that isn't cached.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        low, i = min((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if low == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [rank[p] for p in parts]


@functools.cache
def codec(path: str) -> Codec:
    """One for each Python process: table and cache serve all its tasks."""
    return Codec(path)


class Codec:
    """Encodes texts and decodes ids by the ranks in one file."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.size = max(self.rank.values()) + 1
        self.pieces = [b""] * self.size
        for piece, k in self.rank.items():
            self.pieces[k] = piece
        self.length = np.fromiter(map(len, self.pieces), np.int64, self.size)
        import tiktoken

        core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.rank, special_tokens={})._core_bpe
        self.cache = SliceCache(lambda new: [array("I", ids).tobytes() for ids in map(core.encode_single_piece, new)])

    def encode(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of ids before each text (one entry more than texts)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        wide = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(wide, out=byte[1:])
        start = np.unique(np.searchsorted(byte, ends[:-1][ends[1:] > ends[:-1]]))
        cuts = boundaries(points, start)
        begin = byte[cuts]
        stop = np.append(begin[1:], len(buf))
        ids, each = self.cache.ids(buf, begin, stop)
        before = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(each, out=before[1:])
        return ids, before[np.searchsorted(begin, ends, "left")]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id's piece ends, counted from the first id's start."""
        return np.cumsum(self.length[ids])


def encode_decode(docs: DataFrame, path: str | None = None, offsets: bool = True) -> DataFrame:
    """Add ``token_ids`` (array of int), ``token_ends`` (array of int: byte where each token ends; with
    ``offsets``) and ``decoded`` (binary, from the ids alone) to every row.

    A null text counts as empty: no ids, no bytes. Repeated rows are each encoded. Columns of these
    names in the input are replaced; all others stay. ``path``: a file of ranks, on every machine.
    """
    path = path or public_tokenizers.path(RANKS)
    shared.shared_dir(docs.sparkSession)
    new = ("token_ids", *(["token_ends"] if offsets else []), "decoded")
    return shared.aside(docs, ("text",), lambda rows: _coded(rows, path, offsets, new), new)


def _coded(docs: DataFrame, path: str, offsets: bool, new: tuple[str, ...]) -> DataFrame:
    source = "encoded text"
    base = docs.withColumn(source, F.coalesce(F.col("text").cast("string"), F.lit("")))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.BinaryType() if n == "decoded" else T.ArrayType(T.IntegerType(), False)) for n in new)])
    names = [*docs.columns, *new]

    def run(batches):
        coder = codec(path)
        for batch in batches:
            buf, ends = shared.rows_of(batch.column(source))
            for a, b in shared.slices(ends, SLICE):
                part, own = buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                ids, before = coder.encode(part, own)
                where = pa.array(before.astype(np.int32))
                made = {"token_ids": pa.ListArray.from_arrays(where, pa.array(ids.astype(np.int32)))}
                if offsets:
                    run_on = np.cumsum(coder.length[ids])
                    shift = np.repeat(np.append(0, run_on)[before[:-1]], np.diff(before))
                    made["token_ends"] = pa.ListArray.from_arrays(where, pa.array((run_on - shift).astype(np.int32)))
                made["decoded"] = pa.array([coder.decode(ids[x:y]) for x, y in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)], pa.binary())
                yield shared.with_columns(batch.slice(a, b - a), made, names)

    return base.mapInArrow(run, schema)
