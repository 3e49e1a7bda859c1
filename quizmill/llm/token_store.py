"""Token ids in binary files: one zstandard frame for each document, with a shared dictionary.

A file holds, in this order: the 8 bytes ``QMTOKEN1``; the SHA-256 of the dictionary (32 bytes);
the frames; the index, 32 bytes a document, all little-endian 64-bit: doc_id, place of the frame
in the file, its length, its number of ids; at last the place of the index and the number of
documents. A frame holds the ids as little-endian unsigned 32-bit integers. ``dictionary.zstd``
lies beside the files. To read one document takes the last 16 bytes, the index and its frame.

Documents lie in ascending doc_id order over the files in the order of their names. A null
doc_id is written as the smallest 64-bit integer and read as null. A null text counts as empty,
so its document has the end id only. Repeated rows are each written. Columns other than doc_id and text
are left out, whatever their names; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm import shared
from quizmill.llm.textvec import SliceCache, words

TOKENIZER = "word_bpe_49k.json"
MAGIC = b"QMTOKEN1"
NO_ID = -(2**63)
SLICE = 1 << 20
#: Words on which the tokenizer's normal form is plain lower case, what its pattern cuts them into, and its sign for each byte that has none.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
BYTE_SIGNS = np.arange(256, dtype="<u2")
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_SIGNS[_HIDDEN] = np.arange(256, 256 + len(_HIDDEN))
BYTE_SIGNS[0x0A] = 0x0A  # stands between words here
#: Stands after each word's ids while words are cut together; no id below 2^24 has four such bytes, nor do two neighbours.
END_OF_WORD = b"\xff" * 4
#: Pieces of words whose ids are kept at once.
MOST_PIECES = 200_000
#: The dictionary is trained on so many documents at most, the ones whose hashes are lowest, and so many bytes of each, from a place that a hash of its ids names.
TRAIN_DOCS, TRAIN_BYTES, DICT_BYTES = 1000, 4096, 64 << 10
#: Bytes of text for each file.
PART = 256 << 20
_ENTRY = np.dtype([("doc_id", "<i8"), ("at", "<i8"), ("length", "<i8"), ("ids", "<i8")])


def byte_signs(text: str) -> str:
    """The sign of each byte of the text's UTF-8 form."""
    return BYTE_SIGNS[np.frombuffer(text.encode("utf-8"), np.uint8)].tobytes().decode("utf-16-le")


class WordCodec:
    """Ids of whole texts by a tokenizer that drops white space: each different word is encoded once while cached.

    Texts that hold one of the tokenizer's added tokens go through the library whole, as these are found before words are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = list(tokenizer.get_added_tokens_decoder().values())
        self.tokenizer, self.added = tokenizer, [t.content.encode() for t in added]
        self.all_whole = any(t.normalized for t in added)  # such tokens are found in a normal form, not in the text
        model = tokenizer.model
        pieces: dict[str, bytes] = {}

        def of_plain(words_: list[str]) -> list[bytes]:
            """Words of plain Latin letters and ASCII signs, cut by one pass over all of them; each different piece goes straight to the library's merges."""
            cut = PIECES.findall("\n".join(words_).lower())
            new = [x for x in dict.fromkeys(cut) if x not in pieces and x != "\n"]
            if len(pieces) + len(new) > MOST_PIECES:
                pieces.clear()
                new = [x for x in dict.fromkeys(cut) if x != "\n"]
            other = [x for x in new if not x.isascii()]
            signs = dict(zip(other, byte_signs("\n".join(other)).split("\n"), strict=True)) if other else {}
            for x in new:
                pieces[x] = array("I", [t.id for t in model.tokenize(signs.get(x, x))]).tobytes()
            pieces["\n"] = END_OF_WORD
            return b"".join(map(pieces.__getitem__, cut)).split(END_OF_WORD)

        def compute(new: list[bytes]) -> list[bytes]:
            """The ids of each word. Words with other signs than plain ones go all the library's way."""
            text = b"\n".join(new).decode("utf-8").split("\n")
            plain = [w for w in text if PLAIN.fullmatch(w)]
            if len(plain) == len(text):
                return of_plain(plain)
            known = dict(zip(plain, of_plain(plain), strict=True)) if plain else {}
            return [known[w] if w in known else array("I", tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in text]

        self.cache = SliceCache(compute)

    def encode(self, buf: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each text's followed by end_id, and the number of ids before each text."""
        starts, stops, before = words(buf, ends)
        ids, each = self.cache.ids(buf, starts, stops)
        run = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(each, out=run[1:])
        cuts = run[before]
        out, at = np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(ends))
        raw = buf.tobytes()
        whole = self.with_added(raw, ends)
        if not whole:
            return out, at
        size, parts, last = np.diff(at), [], 0
        for k in whole:
            own = self.tokenizer.encode(raw[ends[k] : ends[k + 1]].decode("utf-8"), add_special_tokens=False).ids
            parts += [out[at[last] : at[k]], np.array([*own, end_id], out.dtype)]
            size[k], last = len(own) + 1, k + 1
        return np.concatenate([*parts, out[at[last] :]]), np.cumsum([0, *size])

    def with_added(self, raw: bytes, ends: np.ndarray) -> list[int]:
        """The texts that hold an added token."""
        if self.all_whole:
            return list(range(len(ends) - 1))
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(ends, at, "right")) - 1
                inside = at + len(token) <= ends[k + 1]
                if inside:
                    found.add(k)
                at = raw.find(token, int(ends[k + 1]) if inside else at + 1)
        return sorted(found)


@functools.cache
def word_codec(path: str) -> WordCodec:
    """One for each Python process: its cache serves all tasks there."""
    return WordCodec(path)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


@functools.cache
def _dictionary(folder: str) -> bytes:
    where, path = _open(folder)
    with where.open_input_stream(f"{path}/dictionary.zstd") as f:
        return f.read()


def sample_slice(ids: np.ndarray) -> bytes:
    """TRAIN_BYTES of a document's ids, from any place of it; all of a shorter one."""
    raw = ids.astype("<u4").tobytes()
    at = zlib.crc32(raw) % (max(0, len(raw) - TRAIN_BYTES) // 4 + 1) * 4
    return raw[at : at + TRAIN_BYTES]


def train_dictionary(rows: DataFrame, end_id: int, tokenizer: str) -> bytes:
    """A dictionary from the documents of lowest hash, TRAIN_DOCS at most. It affects sizes only, never ids."""
    import zstandard

    # ranked by id and hash of the text first, so that no task carries more texts than the sample has, also where ids repeat
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("key"))
    chosen = keyed.select("doc_id", "key").distinct().orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(TRAIN_DOCS)
    sample = keyed.join(F.broadcast(chosen), keyed.doc_id.eqNullSafe(chosen.doc_id) & (keyed.key == chosen.key), "left_semi").select("text")

    def serialize(batches):
        for batch in batches:
            buf, ends = shared.rows_of(batch.column(0))
            for a, b in shared.slices(ends, SLICE):
                ids, before = word_codec(tokenizer).encode(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], end_id)
                yield pa.RecordBatch.from_arrays([pa.array([sample_slice(ids[x:y]) for x, y in zip(before[:-1], before[1:], strict=True)], pa.binary())], names=["part"])

    # rows of one id and text give one part
    parts = sorted(r.part for r in sample.mapInArrow(serialize, "part binary").distinct().collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too few documents to learn from
        return b""


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, level: int = 3) -> DataFrame:
    """Write the ids of all documents to files in ``folder``, a URI that driver and executors share.

    Returns, from the manifest kept in ``folder/manifest``, a row for each file: name, first and last
    doc_id, documents, ids. Nothing is written twice: a task that runs again replaces its file whole.
    """
    import zstandard

    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = shared.texts_of(docs, "doc_id")
    spark: SparkSession = docs.sparkSession
    raw = train_dictionary(rows, end_id, tokenizer)
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/dictionary.zstd") as f:
        f.write(raw)
    mark = hashlib.sha256(raw).digest()

    def save(batches):
        import itertools

        from pyspark import TaskContext

        first = next(batches, None)
        while first is not None and first.num_rows == 0:
            first = next(batches, None)
        if first is None:
            return
        where, path = _open(folder)
        name = f"tokens-{TaskContext.get().partitionId():06d}.qmt"
        temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
        known = _dictionary(folder)
        shared_words = zstandard.ZstdCompressionDict(known) if known else None
        if shared_words is not None:
            shared_words.precompute_compress(level=level)  # else each frame would digest the dictionary anew
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared_words)
        entries, at, crc, least, most = [], len(MAGIC) + 32, 0, None, None
        with where.open_output_stream(temporary) as f:
            f.write(MAGIC + mark)
            for batch in itertools.chain([first], batches):
                doc_ids = np.asarray(batch.column(0).fill_null(NO_ID))
                buf, ends = shared.rows_of(batch.column(1))
                for a, b in shared.slices(ends, SLICE):
                    ids, before = word_codec(tokenizer).encode(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], end_id)
                    ids = ids.astype("<u4")
                    frames = [packer.compress(ids[x:y].tobytes()) for x, y in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                    size = np.fromiter(map(len, frames), np.int64, len(frames))
                    entry = np.empty(b - a, _ENTRY)
                    entry["doc_id"], entry["length"], entry["ids"] = doc_ids[a:b], size, np.diff(before)
                    entry["at"] = at + np.cumsum(size) - size
                    at += int(size.sum())
                    entries.append(entry)
                    f.write(b"".join(frames))
            index = np.concatenate(entries)
            f.write(index.tobytes() + struct.pack("<QQ", at, len(index)))
        where.move(temporary, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "first_id": pa.array([int(index["doc_id"][0])], pa.int64()), "last_id": pa.array([int(index["doc_id"][-1])], pa.int64()), "docs": pa.array([len(index)], pa.int64()), "ids": pa.array([int(index["ids"].sum())], pa.int64())})

    parts = shared.parts_for(spark, shared.bytes_of(rows), PART)
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(save, "file string, first_id long, last_id long, docs long, ids long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class File:
    """One file, opened for the reading of single documents."""

    def __init__(self, folder: str, name: str):
        import zstandard

        where, path = _open(folder)
        self.file = where.open_input_file(f"{path}/{name}")
        raw = _dictionary(folder)
        if self.file.read_at(len(MAGIC) + 32, 0) != MAGIC + hashlib.sha256(raw).digest():
            raise ValueError(f"{name} was not written with the dictionary beside it")
        size = self.file.size()
        at, n = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.index = np.frombuffer(self.file.read_at(n * _ENTRY.itemsize, at), _ENTRY)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        return np.frombuffer(self.unpacker.decompress(self.file.read_at(int(e["length"]), int(e["at"]))), "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each row that has this doc_id."""
        a, b = np.searchsorted(self.index["doc_id"], [doc_id, doc_id + 1])
        return [self.ids(k) for k in range(a, b)]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, frame_at.

    Files are read by as many tasks as there are files; only the files' id counts are summed up on the
    driver, one number for each file.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = sorted((r.file, r.ids) for r in manifest.select("file", "ids").collect())
    start, plan = 0, []
    for k, (name, n) in enumerate(files):
        plan.append((k, name, start))
        start += n

    def load(batches):
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                f = File(folder, name)
                for a in range(0, len(f.index), 4096):
                    part = f.index[a : a + 4096]
                    got = [f.ids(k) for k in range(a, a + len(part))]
                    count = np.fromiter(map(len, got), np.int64, len(got))
                    crc = [zlib.crc32(x.tobytes()) for x in got]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part["doc_id"], mask=part["doc_id"] == NO_ID), "start": start + np.cumsum(count) - count, "n_tokens": count, "ids_crc32": pa.array(crc, pa.int64()), "file": pa.array([name] * len(part)), "frame_at": part["at"]})
                    start += int(count.sum())

    rows = spark.createDataFrame(plan, "k int, file string, start long")
    return rows.repartitionById(max(1, len(plan)), F.col("k")).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame_at long")
