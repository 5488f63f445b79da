"""Words of many texts at once, as 64-bit hashes, by numpy over the bytes of a string column.

A word is a maximal run of bytes that a table calls word bytes, after A-Z are lower-cased.
Its hash is a polynomial over random byte values modulo 2**64, taken from one cumulative
sum, and then mixed. Memory is bounded: texts are scanned in segments of about SEGMENT
bytes that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19

_B = np.arange(256)
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
#: Words between ASCII white space.
SPACED = ~((_B == 32) | ((_B >= 9) & (_B <= 13)))
#: Words of letters and digits; every byte outside ASCII counts as a letter.
ALNUM = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)

_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _scan(data: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one segment and where they start; no word crosses a cut."""
    inside = table[data]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    before[cuts[cuts < len(data)]] = False
    after[cuts[(cuts > 0) & (cuts <= len(data))] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[LOWER[data]] * up[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def segments(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, words per row) of runs of rows; a null has no words."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, buffer = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + SEGMENT, "right")) - 1)
        if at[last] - at[row] <= 2 * SEGMENT:
            bounds = at[row : last + 1] - at[row]
            hashes, starts = _scan(data[at[row] : at[last]], bounds, table) if bounds[-1] else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield row, last, hashes, np.diff(np.searchsorted(starts, bounds))
        else:  # one long text, cut between words
            parts, a, end = [], int(at[row]), int(at[last])
            while a < end:
                b = min(end, a + SEGMENT)
                while b < end and table[data[b]] and table[data[b - 1]]:
                    step = np.flatnonzero(~table[data[b : b + SEGMENT]])
                    b = min(end, b + (int(step[0]) if len(step) else SEGMENT))
                parts.append(_scan(data[a:b], np.empty(0, np.int64), table)[0])
                a = b
            hashes = np.concatenate(parts)
            yield row, last, hashes, np.array([len(hashes)])
        row = last


def rows(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every row."""
    for first, _, hashes, counts in segments(column, table):
        ends = np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(counts)):
            yield first + i, hashes[ends[i] : ends[i + 1]]
