"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is split by the tokenizer's pattern. A piece is encoded by halves, recursively;
two neighbouring encodings are joined by looking at the boundary: two tokens are
*compatible* when encoding their joined bytes gives back just these two. A sequence whose
neighbours are all compatible is the encoding of its bytes, so where the boundary pair is
compatible the halves are simply concatenated; else a window of boundary tokens is encoded
anew and grows on either side until its outer borders are compatible, which proves that the
tokens outside it stay. Decoding concatenates the tokens' bytes up the same kind of tree.

Pieces and halves repeat, so their encodings are remembered while a task runs, up to a
bounded number. Documents never leave their row: no shuffle.

Defined cases: null and empty texts give no ids and decode to no bytes; ids that are null
decode to no bytes; repeated rows are encoded row by row; other columns are kept, but for
those that have a result's name in any letter case.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import Remembered

#: Remembered halves, boundary pairs and windows, and pieces, per task; a full memory is emptied.
REMEMBERED, PIECES = 150_000, 400_000

#: Windows of more bytes are merged by a heap.
LONG_WINDOW = 64

#: Texts over so many characters are split into pieces lazily, in runs of RUN pieces.
LONG_TEXT, RUN = 1_000_000, 100_000

#: Rows that are turned into one Arrow batch at a time.
ROWS = 1_000


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.pieces = Remembered(self.piece, PIECES)

    def forget(self) -> None:
        """Empty all memories: the Python worker may go on to other work."""
        for memory in (self.halves, self.pairs, self.windows, self.pieces):
            memory.clear()

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merging of the lowest-ranked neighbours; short windows plainly, and remembered."""
        if len(data) > LONG_WINDOW:
            return self.merge_long(data)
        got = self.windows.get(data)
        if got is not None:
            return got
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            best, at = None, 0
            left = parts[0]
            for i in range(1, len(parts)):
                right = parts[i]
                r = rank(left + right)
                if r is not None and (best is None or r < best):
                    best, at = r, i
                left = right
            if best is None:
                break
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
        got = tuple([self.ranks[p] for p in parts])
        if len(data) <= 32:
            if len(self.windows) >= REMEMBERED:
                self.windows.clear()
            self.windows[data] = got
        return got

    def merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same merging with the neighbours in a heap: n log n in the window's bytes."""
        n, rank = len(data), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next and the last part start
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, at, end = heappop(heap)
            middle = after[at]
            if middle in (0, n) or after[middle] != end:
                continue  # one of the two has been merged since
            after[at], after[middle] = end, 0
            if end < n:
                before[end] = at
                if (r := rank(data[at : after[end]])) is not None:
                    heappush(heap, (r, at, after[end]))
            if at > 0 and (r := rank(data[before[at] : end])) is not None:
                heappush(heap, (r, before[at], end))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[data[at : after[at]]])
            at = after[at]
        return tuple(ids)

    def pair(self, left: int, right: int) -> tuple[int, ...]:
        """The encoding of two tokens' joined bytes: the two themselves if they are compatible."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right])
        return got

    def compatible(self, left: int, right: int) -> bool:
        return self.pair(left, right) == (left, right)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        i = j = 1
        window = self.pair(left[-1], right[0])
        while True:
            fits_left = i == len(left) or self.compatible(left[-i - 1], window[0])
            fits_right = j == len(right) or self.compatible(window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if fits_left else min(2 * i, len(left))), (j if fits_right else min(2 * j, len(right)))
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))

    def reduce(self, data: bytes) -> tuple[int, ...]:
        """Encode halves recursively and join them."""
        got = self.halves.get(data)
        if got is None:
            if len(data) < 2:
                return self.merge(data)
            half = len(data) // 2
            got = self.join(self.reduce(data[:half]), self.reduce(data[half:]))
            if len(data) <= 16:
                if len(self.halves) >= REMEMBERED:
                    self.halves.clear()
                self.halves[data] = got
        return got

    def piece(self, text: str) -> bytes:
        """The ids of a piece as 32-bit integers."""
        data = text.encode()
        whole = self.ranks.get(data)  # a piece that is a token is that token
        return np.array(self.reduce(data) if whole is None else (whole,), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return self._ids(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        runs = iter(lambda: list(islice(found, RUN)), [])
        return np.concatenate([self._ids(run) for run in runs])

    def _ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and rank file."""
    return Codec(path, pattern)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [values], names=[*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids", drop_text: bool = False, decoded: str | None = None) -> DataFrame:
    """The rows with a column of token ids (array of int) last; an older column of that name is replaced.

    With `decoded`, a binary column of what the ids decode to follows, from the same pass.
    """

    def run(batches):
        own = codec(path, pattern)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    rows = [own.encode(x) if x else np.empty(0, np.int32) for x in batch.column(text).to_pylist()]
                    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))
                    out = _with_column(batch.drop_columns([text]) if drop_text else batch, ids, values)
                    yield _with_column(out, decoded, pa.array([own.decode(r) for r in rows], pa.binary())) if decoded else out
        finally:
            own.forget()

    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text) and f.name.lower() not in (ids.lower(), (decoded or ids).lower())]
    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def decode(df: DataFrame, path: str, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with a binary column of the decoded bytes last."""

    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = batch.column(ids)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
                rows = [own.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
                yield _with_column(batch, decoded, pa.array(rows, pa.binary()))

    return df.mapInArrow(run, _schema(df, decoded, T.BinaryType()))
