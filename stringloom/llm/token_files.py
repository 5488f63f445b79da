"""Token-id files: bit-plane or byte-plane shuffled blocks, zstandard and a chunk index.

Documents are dealt out by ranges of doc_id and sorted, so the files, in order, hold all
ids in ascending doc_id order. Each task streams its partition into one file:

    magic | blocks | directory (zstandard JSON) | length of the directory (8 bytes) | magic

A block holds up to BLOCK ids. Its ids, as little-endian unsigned integers of `width`
bytes, are transposed into planes (byte b, or bit b, of every id together) and each plane
is compressed by itself. The directory has offset, ids and plane sizes of every block, and
the documents' ids and lengths, kept in the same way. A file's name is unique to the task
attempt and only the finished attempt's row reaches the written manifest, so retried tasks
leave no wrong ids behind.

Defined cases: a null or empty text is just the end id; a null doc_id comes first; rows
with equal doc_id follow their text's order; an empty table gives no file; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Remembered, settle, shared_dir

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16

#: Chunks of text that a worker remembers the ids of; a full memory is emptied.
REMEMBERED = 1_000_000

#: Rows encoded together.
ROWS = 500


# ------------------------------------------------------------------- the planes
def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """Byte or bit planes of a block."""
    if len(ids) and width < 8 and int(ids.max()) >> (8 * width):
        raise ValueError(f"id {int(ids.max())} doesn't fit in {width} bytes")
    raw = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1) if n else np.empty((0, width), np.uint8)
    else:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes])
        raw = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(-1)


class Writer:
    """One file, written block by block."""

    def __init__(self, sink, width: int = 4, kind: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.sink, self.width, self.kind, self.block = sink, width, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.n_ids, self.wait, self.waiting = len(MAGIC), 0, [], 0
        self.blocks: list[list] = []
        self.docs: list[tuple[list, np.ndarray]] = []
        sink.write(MAGIC)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, lengths))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            joined = np.concatenate(self.wait)
            full = len(joined) // self.block * self.block
            for a in range(0, full, self.block):
                self._put(joined[a : a + self.block])
            self.wait, self.waiting = [joined[full:]], len(joined) - full

    def _put(self, ids: np.ndarray) -> None:
        parts = [self.pack(p) for p in to_planes(ids, self.width, self.kind)]
        self.blocks.append([self.at, len(ids), [len(p) for p in parts]])
        for p in parts:
            self.sink.write(p)
        self.at += sum(map(len, parts))
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.wait))
        keys = list(chain.from_iterable(d for d, _ in self.docs))
        null = [i for i, k in enumerate(keys) if k is None]
        columns = [np.array([0 if k is None else k for k in keys], np.int64), np.concatenate([n for _, n in self.docs]).astype(np.int64)]
        stored = [[self.pack(p) for p in to_planes(c.view(np.uint64), 8, "byte")] for c in columns]
        at = []
        for parts in stored:
            at.append([self.at, len(keys), [len(p) for p in parts]])
            for p in parts:
                self.sink.write(p)
            self.at += sum(map(len, parts))
        directory = self.pack(json.dumps({"width": self.width, "kind": self.kind, "blocks": self.blocks, "docs": at, "null": null}).encode())
        self.sink.write(directory + struct.pack("<Q", len(directory)) + MAGIC)


class Reader:
    """One file; blocks are read one by one by their index."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a finished id file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.directory = json.loads(self.unpack(self._at(size - 16 - n, n)))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _block(self, offset: int, n: int, sizes: list[int], width: int, kind: str) -> np.ndarray:
        data, planes, at = self._at(offset, sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unpack(data[at : at + s]))
            at += s
        return from_planes(planes, n, width, kind)

    def documents(self):
        """(doc_id, offset in the file, ids) of every document, in order."""
        d = self.directory
        keys, lengths = (self._block(*x, 8, "byte").view(np.int64) for x in d["docs"])
        null, have, at, blocks = set(d["null"]), np.empty(0, np.uint32), 0, iter(d["blocks"])
        for i, (key, n) in enumerate(zip(keys.tolist(), lengths.tolist())):
            parts = [have]
            held = len(have)
            while held < n:
                parts.append(self._block(*next(blocks), d["width"], d["kind"]).astype(np.uint32))
                held += len(parts[-1])
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield None if i in null else key, at, have[:n]
            have, at = have[n:], at + n


# ------------------------------------------------------------------- the encoder
class Encoder:
    """The tokenizers library, asked once for each chunk between white space.

    Special tokens' strings are cut out of the text as it stands and give their ids, as the
    library does. Between them, the tokenizer drops white space and none of its rules look
    across it, so a text's ids are its chunks' ids one after another. It lower-cases letter
    by letter, so texts within LATIN are lower-cased at once. A chunk of plain letters, with a
    full stop or comma after them or not, is one or two of the tokenizer's own words, which its
    model encodes without the steps before; every other chunk takes the whole tokenizer.

    All this holds for tokenizers with the STEPS below; with others, whole texts are encoded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        added = steps["added_tokens"]
        plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        self.by_chunk = plain and all(steps[k] == v for k, v in STEPS.items())
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.tokenizer.encode_special_tokens = True  # between special tokens, what lower-casing makes of a text is text
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known = Remembered(self.ids, REMEMBERED)  # ids as little-endian unsigned 32-bit integers

    def chunks(self, text: str) -> list[str]:
        text = text if BEYOND_LATIN.search(text) else text.lower()
        # str.split() also takes 0x1C-0x1F for white space, the tokenizer doesn't
        return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else _split(text)

    def ids(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't remembered."""
        stem = chunk[:-1] if chunk[-1] in ".," else chunk
        if len(stem) < len(chunk) and PLAIN.fullmatch(stem):
            return self.known[stem] + self.word(chunk[-1])
        if PLAIN.fullmatch(chunk):
            return self.word(chunk if chunk.isascii() else self.bytes.pre_tokenize_str(chunk)[0][0])
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, shown: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def text(self, text: str) -> bytes:
        """The ids of a text as packed integers."""
        known = self.known.__getitem__
        if self.cut and self.cut.search(text):
            return b"".join([self.special[x] if x in self.special else b"".join(map(known, self.chunks(x))) for x in self.cut.split(text)])
        return b"".join(map(known, self.chunks(text)))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the texts, each followed by the end id."""
        last = end.to_bytes(4, "little")
        if self.by_chunk:
            packed = [self.text(x) + last if x else last for x in texts]
        else:
            packed = [np.array([*x.ids, end], "<u4").tobytes() for x in self.whole.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        return lengths, np.frombuffer(b"".join(packed), "<u4")


#: The steps that the short ways rest on (fixed values of the tokenizer's file).
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: Plain lower-case letters; characters past the Latin blocks.
PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def _split(text: str) -> list[str]:
    return [x for x in re.split(r"[\t-\r \x85\xa0  -     　]+", text) if x]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------------- the jobs
def write(docs: DataFrame, path: str, *, end: int = 2, key: str = "doc_id", text: str = "text", width: int = 4, kind: str = "byte", block: int = BLOCK) -> DataFrame:
    """Write the documents' ids; the manifest (file_no, path, n_docs, n_ids, start), a row per file."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(n, "k").sortWithinPartitions("k", "t")

    def run(batches):
        from pyspark import TaskContext

        fs = out = None
        number, docs_in = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if out is None:
                    fs, base = filesystem(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{number:06d}-{uuid.uuid4().hex}.ids"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    out = Writer(sink, width, kind, block)
                lengths, ids = encoder(path).encode(batch.column("t").to_pylist(), end)
                out.add(batch.column("k").to_pylist(), lengths, ids)
                docs_in += batch.num_rows
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f"{folder}/{name}"]), pa.array([docs_in], pa.int64()), pa.array([out.n_ids], pa.int64())], names=["file_no", "path", "n_docs", "n_ids"])

    files = settle(dealt.mapInArrow(run, "file_no long, path string, n_docs long, n_ids long"), "id-files")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def filesystem(uri: str):
    """The file system of a shared folder and the path in it."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document from the files; ids as little-endian unsigned 32-bit bytes."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as source:
                    rows: list[tuple] = []
                    size = 0
                    for key, at, ids in Reader(source).documents():
                        rows.append((key, start + at, len(ids), ids.astype("<u4").tobytes()))
                        size += rows[-1][2]
                        if size >= 1 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return manifest.select("file_no", "path", "start").repartition(n, "file_no").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    keys, starts, counts, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
