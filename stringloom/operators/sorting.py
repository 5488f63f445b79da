"""Suffix order of a batch of texts in numpy: the helper of suffix.py, for texts that lie whole in a row.

The texts of a batch are sorted together, a text's number first. A position starts with as many
of its next characters as fit into 64 bits with that number; then ranks are doubled by the rank
that far ahead, for positions alone whose rank is still shared. The ranks of all rounds are kept:
from the longest to the shortest, equal ranks move both positions of a pair of neighbours on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Positions that are sorted together, about; a longer text is sorted alone.
STEP = 1 << 20


class Sorted(NamedTuple):
    """All suffixes of some texts, in order within each text, the empty one first."""

    row: np.ndarray  #: which text
    rank: np.ndarray
    sa: np.ndarray
    lcp: np.ndarray
    bwt: np.ndarray  #: number of the character before, from 1; 0 at the text's start
    letters: pa.Array  #: the characters by number, null for 0
    lengths: np.ndarray  #: characters of each text

    def characters(self, numbers: np.ndarray) -> pa.Array:
        return self.letters.take(pa.array(numbers, pa.int32()))


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first place, texts): runs of texts of about STEP positions."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) >= STEP:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text) + 1
    if size:
        yield first, texts[first:]


class Heads(NamedTuple):
    """All positions of some texts, the end of each included, with the characters that follow."""

    first: np.ndarray  #: a text's first position, and where the last one ends
    row: np.ndarray  #: which text
    at: np.ndarray  #: the place in it
    numbers: np.ndarray  #: the character's number, from 1; 0 ends a text
    alphabet: np.ndarray  #: the characters by number, less 1
    packed: np.ndarray  #: the text's number, then those of `size` characters of `bits` bits each
    bits: int
    size: int


def heads(texts: list[str], width: int) -> Heads:
    """The positions of texts with up to `width` characters, as many as fit."""
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = int(first[-1])
    row = np.repeat(np.arange(len(texts)), lengths + 1)
    at = np.arange(n) - first[row]
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = first[1:] - 1
    alphabet, codes = np.unique(np.delete(points, ends), return_inverse=True)
    numbers = np.insert(codes + 1, ends - np.arange(len(ends)), 0)
    bits = max(1, len(alphabet).bit_length())
    size = max(1, min(width, n, (63 - max(1, len(texts) - 1).bit_length()) // bits))

    packed, left = np.zeros(n, np.int64), lengths[row] - at
    for k in range(size):
        packed <<= bits
        packed[: n - k] |= np.where(left[: n - k] > k, numbers[k:], 0)
    packed |= row << (bits * size)
    return Heads(first, row, at, numbers, alphabet, packed, bits, size)


def sort(texts: list[str], width: int) -> Sorted:
    """The suffixes of texts, none of them empty; the first round compares up to `width` characters."""
    first, row, sa, numbers, alphabet, packed, bits, head = heads(texts, width)
    lengths, n = np.diff(first) - 1, len(row)

    order = np.argsort(packed, kind="stable")
    moved = np.concatenate([[True], packed[order[1:]] != packed[order[:-1]]])
    rank = np.empty(n, np.int64)
    starts = np.maximum.accumulate(np.where(moved, np.arange(n), 0))
    rank[order] = starts
    shared = ~moved
    shared[:-1] |= ~moved[1:]
    open_, levels, size = order[shared], [], head
    while len(open_):
        levels.append((size, rank.astype(np.int32 if n < 1 << 31 else np.int64)))
        # a shared rank has not met its text's end, so that what is asked lies in the same text
        own, ahead = rank[open_], rank[open_ + size]
        by = np.lexsort((ahead, own)) if n >= 1 << 31 else np.argsort(own * n + ahead, kind="stable")
        open_, own, ahead = open_[by], own[by], ahead[by]
        place = np.arange(len(open_))
        group = np.concatenate([[True], own[1:] != own[:-1]])
        apart = group.copy()
        apart[1:] |= ahead[1:] != ahead[:-1]
        rank[open_] = own + np.maximum.accumulate(np.where(apart, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        shared = ~apart
        shared[:-1] |= ~apart[1:]
        open_, size = open_[shared], size * 2
    order[rank] = np.arange(n)

    done = np.zeros(n, np.int64)
    pairs = np.flatnonzero(starts == np.arange(n))  # positions in order that the first round told from the one before
    later = np.ones(n, bool)
    later[pairs] = False
    later = np.flatnonzero(later)
    a, b, far = order[later], order[later - 1], np.zeros(len(later), np.int64)
    for size, ranks in reversed(levels):
        far += np.where(ranks[a + far] == ranks[b + far], size, 0)
    done[later] = far
    before = np.concatenate([order[:1], order[:-1]])
    differ = packed[order + done] ^ packed[before + done]
    same_text = row[order] == row[before]
    lcp = done
    for k in range(head):
        lcp = lcp + (differ >> (bits * (head - 1 - k)) == 0)
    lcp[np.concatenate([[0], np.flatnonzero(~same_text)])] = 0

    sa, row = sa[order], row[order]
    bwt = np.where(sa > 0, numbers[order - 1], 0)
    letters = pa.array([None, *(chr(c) for c in alphabet)], pa.string())
    return Sorted(row, np.arange(n) - first[row], sa, lcp, bwt, letters, lengths)
