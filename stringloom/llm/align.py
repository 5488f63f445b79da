"""Cross-tokenizer alignment: groups of two tokenizers' tokens between the byte offsets where both end a token.

Divide and conquer at shared cuts. The tokens' end offsets of a batch of texts are laid one
behind another. For every interval of A's tokens, a common end is looked for from the middle
outwards, each probe by bisecting B's ends; what lies on either side of it is an interval of
the next round, less the ends that were probed in vain. Intervals without a common end are
leaf groups. All intervals of a round advance together in numpy, so no text's nesting is a
recursion in Python.

Tokens of A and B are linked where they share a group. A pair of ids counts the documents
that hold it linked. These counts cover all documents: distinct pairs of each document are
counted in parts before they are shuffled. Back to the documents, pairs with more than one in
COMMON of all rows, at most COMMON pairs, reach the tasks by broadcast; the others meet their
rows in a shuffle join in which no pair has more rows than that. So no common pair is hot.

Chunks of text between a space and the next are tokenized once per worker while they stay in
a memory bounded in chunks and in ids. Both vocabularies are checked for tokens that reach
over such a border; if there is one, whole texts are tokenized.

Defined cases: texts null or empty, and texts that the tokens' bytes don't give back, have no
tokens, zeros and the empty groups_sha256. A null doc_id is kept; repeated rows count as
documents of their own. An empty table gives an empty table. A column of the input that has
the name of a result, in any case, is replaced; others are kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, settle, small_batches, trim, without

#: Pairs with more than one in COMMON of all rows are sent to the tasks: COMMON rows of 24 bytes at most.
COMMON = 1 << 17

#: Chunks and their ids that a worker remembers between batches; beyond, only chunks used more than once stay.
REMEMBERED, REMEMBERED_IDS = 300_000, 8_000_000

#: Characters of text that are worked on together.
BATCH_CHARS = 1 << 20

#: Links of a group up to which they are listed one by one; larger groups go by their distinct ids.
LISTED = 256

#: A space between two printable characters that no white space rule or letter class tells apart.
BORDER = re.compile(r" (?<=[!-~À-ɏͰ-ӿ一-鿿] )(?=[!-~À-ɏͰ-ӿ一-鿿])")


# ------------------------------------------------------------------- the tokenizers
def _byte_alphabet() -> dict[str, int]:
    """Bytes of the byte-level alphabet: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers of a worker, their tokens' bytes and the chunks they remember."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes: list[bytes] = [b""] * (max(entries.values(), default=-1) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        model = json.loads(self.a.to_str())
        byte_level = (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model.get("normalizer")
        crossing = re.compile(rb"[^ ] ")
        self.chunked = byte_level and not any(map(crossing.search, self.b_bytes)) and self.b.encode("a  b cﬁ d") == self.b.encode("a  b cﬁ") + self.b.encode("d")
        self.known: dict[str, int] = {}
        self.sides = [_Rows(), _Rows()]
        self.good, self.uses = np.empty(0, bool), np.empty(0, np.int64)
        self.spelled = {sep: (self._spelled(len(self.a_bytes), sep), self._spelled(len(self.b_bytes), sep)) for sep in ",|;"} | {"": (None, self._spelled(len(self.b_bytes), ""))}

    @staticmethod
    def _spelled(n: int, sep: str) -> np.ndarray:
        return np.array([f"{i}{sep}" for i in range(n)], object)

    def _learn(self, new: list[str]) -> None:
        """Tokenize chunks and remember their ids, and whether the ids' bytes give the chunk back."""
        ids = [x.ids for x in self.a.encode_batch_fast([" " + c for c in new], add_special_tokens=False)], self.b.encode(new, num_threads=1)
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == (" " + c).encode() for c, x, y in zip(new, *ids, strict=True)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        for side, x in zip(self.sides, ids, strict=True):
            side.append(x)
        self.good, self.uses = np.concatenate([self.good, np.array(good, bool)]), np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _thin_out(self) -> None:
        """Keep the chunks used most, at most half of REMEMBERED and none used once."""
        if len(self.known) <= REMEMBERED and sum(len(x.ids) for x in self.sides) <= REMEMBERED_IDS:
            return
        best = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        size = sum(x.sizes for x in self.sides)[best]
        best = best[(self.uses[best] > 1) & (size <= REMEMBERED_IDS // REMEMBERED)]
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(best.tolist())}
        for side in self.sides:
            side.keep(best)
        self.good, self.uses = self.good[best], self.uses[best] // 2

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A, over space+text, and for B, over text: (ids of all texts, how many each text has).

        Null and empty texts, and those that the ids' bytes don't give back, have none.
        """
        self._thin_out()
        split = [BORDER.split(t) if self.chunked else [t] for t in texts]
        self._learn([c for c in dict.fromkeys(c for chunks in split for c in chunks) if c not in self.known])
        sizes = np.array([len(c) for c in split], np.int64)
        at = np.fromiter((i for chunks in split for i in map(self.known.__getitem__, chunks)), np.int64, int(sizes.sum()))
        np.add.at(self.uses, at, 1)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        right = np.ones(len(texts), bool)
        right[text_of[~self.good[at]]] = False
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(~right):  # chunks that fail alone could still fit together
            own = at[starts[i] : starts[i] + sizes[i]]
            right[i] = all(b"".join(table[x] for x in side.take(own).tolist()) == (" " + texts[i]).encode() for side, table in zip(self.sides, (self.a_bytes, self.b_bytes), strict=True))
        right &= np.array([bool(t) for t in texts], bool)
        kept = right[text_of]
        return [(side.take(at[kept]), np.bincount(text_of[kept], side.sizes[at[kept]], len(texts)).astype(np.int64)) for side in self.sides]


class _Rows:
    """Lists of ids, one behind another."""

    def __init__(self):
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def append(self, rows: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in rows], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))])

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids of these rows, one behind another."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - ends + sizes, sizes)].astype(np.int64)

    def keep(self, at: np.ndarray) -> None:
        ids, sizes = self.take(at).astype(np.int32), self.sizes[at]
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs.clear()
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


# ------------------------------------------------------------------- the alignment
def shared_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b, both ascending, of the values that both hold: divide and conquer from the middle."""
    low, high = np.zeros(min(1, len(a)), np.int64), np.full(min(1, len(a)), len(a), np.int64)
    found_a, found_b = [], []
    while len(low):
        middle = (low + high) // 2
        open_, k = np.arange(len(low)), 0
        left, right = low.copy(), high.copy()  # what stays on either side; an interval without a cut stays whole and ends
        cut = np.full(len(low), -1, np.int64)
        while len(open_):
            at = middle[open_] + ((k + 1) // 2 if k % 2 else -(k // 2))
            inside = (at >= low[open_]) & (at < high[open_])
            probe = np.flatnonzero(inside)
            j = np.searchsorted(b, a[at[probe]])
            hit = np.zeros(len(probe), bool)
            real = j < len(b)
            hit[real] = b[j[real]] == a[at[probe[real]]]
            rows = open_[probe[hit]]
            cut[rows] = at[probe[hit]]
            found_a.append(cut[rows])
            found_b.append(j[hit])
            left[rows], right[rows] = middle[rows] - k // 2, middle[rows] + (k + 1) // 2 + 1
            k += 1
            spent = (middle[open_] - k // 2 < low[open_]) & (middle[open_] + (k + 1) // 2 >= high[open_])
            going = ~spent
            going[probe[hit]] = False
            open_ = open_[going]
        done = cut >= 0
        low, high = np.concatenate([low[done], right[done]]), np.concatenate([np.minimum(left[done], cut[done]), high[done]])
        some = low < high
        low, high = low[some], high[some]
    order = np.argsort(np.concatenate(found_a or [low]))
    return np.concatenate(found_a or [low])[order], np.concatenate(found_b or [low])[order]


def _groups(places: np.ndarray, n: int) -> np.ndarray:
    """The group of each of n tokens, given the last tokens of the groups."""
    marks = np.zeros(n + 1, np.int64)
    marks[places + 1] = 1
    return np.cumsum(marks)[:n]


def _links(ids_a, ids_b, start_a, start_b, n_a, n_b, doc, width_b: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(document and pair as one number, links) of all groups; `doc` is each group's document."""
    keys, times = [], []
    few = n_a * n_b <= LISTED
    size = (n_a * n_b)[few]
    if len(size):
        g = np.repeat(np.flatnonzero(few), size)
        nth = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
        keys.append(doc[g] * span + ids_a[start_a[g] + nth // n_b[g]] * width_b + ids_b[start_b[g] + nth % n_b[g]])
        times.append(np.ones(len(g), np.int64))
    for g in np.flatnonzero(~few):
        x, cx = np.unique(ids_a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        y, cy = np.unique(ids_b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        keys.append((doc[g] * span + x[:, None] * width_b + y[None, :]).ravel())
        times.append((cx[:, None] * cy[None, :]).ravel())
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def align(pair: Pair, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, links of each pair) of every text."""
    (a, sizes_a), (b, sizes_b) = pair.encode(texts)
    nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
    if not len(a):
        yield from (nothing for _ in texts)
        return
    # the texts' bytes lie one behind another, so that a text's end is a shared cut
    cut_a, cut_b = shared_cuts(np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b]))
    group_a, group_b = _groups(cut_a, len(a)), _groups(cut_b, len(b))
    start_a, start_b = np.concatenate([[0], cut_a[:-1] + 1]), np.concatenate([[0], cut_b[:-1] + 1])
    n_a, n_b = np.diff(np.concatenate([start_a, [len(a)]])), np.diff(np.concatenate([start_b, [len(b)]]))
    text_of = np.repeat(np.arange(len(texts)), sizes_a)
    doc = text_of[start_a]
    width_b = len(pair.b_bytes)
    span = len(pair.a_bytes) * width_b
    keys, times = _links(a, b, start_a, start_b, n_a, n_b, doc, width_b, span)
    ends = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
    # the groups spelled: a group's tokens of A, then those of B
    out = np.empty(len(a) + len(b), object)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[cut_a], last_b[cut_b] = True, True
    at_a, at_b = np.arange(len(a)) + start_b[group_a], np.arange(len(b)) + (start_a + n_a)[group_b]
    out[at_a] = np.where(last_a, pair.spelled["|"][0][a], pair.spelled[","][0][a])
    out[at_b] = np.where(last_b, pair.spelled[";"][1][b], pair.spelled[","][1][b])
    final = np.cumsum(sizes_b)[sizes_b > 0] - 1
    out[at_b[final]] = pair.spelled[""][1][b[final]]
    spots = np.concatenate([[0], np.cumsum(sizes_a + sizes_b)])
    groups, links = np.bincount(doc, minlength=len(texts)), np.bincount(doc, (n_a * n_b).astype(float), len(texts))
    for i in range(len(texts)):
        if not sizes_a[i]:
            yield nothing
            continue
        said = "".join(out[spots[i] : spots[i + 1]].tolist())
        yield int(sizes_a[i]), int(sizes_b[i]), int(groups[i]), int(links[i]), hashlib.sha256(said.encode()).hexdigest(), keys[ends[i] : ends[i + 1]] - i * span, times[ends[i] : ends[i + 1]]


RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def link(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * B's size + b) and each pair's links in the text."""
    small_batches(docs.sparkSession)
    kept = without(docs, "pairs", "times", *RESULTS)
    names = [c for c in kept.columns if c != "text"]
    fields = [T.StructField(n, T.LongType()) for n in RESULTS[:4]] + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            rows, lengths = batch.select(names) if names else None, np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(column):
                before = int(lengths[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(lengths, before + BATCH_CHARS, "right")))
                found = list(align(pair, [t or "" for t in column.slice(at, end - at).to_pylist()]))
                numbers = [pa.array([x[i] for x in found], pa.int64()) for i in range(4)]
                lists = []
                for i in (5, 6):
                    offsets = np.concatenate([[0], np.cumsum([len(x[i]) for x in found])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[i] for x in found]), pa.int64())))
                own = [rows.column(n).slice(at, end - at) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array([x[4] for x in found], pa.string()), *lists], names=[*names, *(f.name for f in fields)])
                at = end
        trim()

    return kept.mapInArrow(work, T.StructType([kept.schema[n] for n in names] + fields))


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256."""
    import sentencepiece

    linked = link(docs, a_path, b_path)
    row = fresh(linked, "row")
    linked = settle(linked.withColumn(row, F.monotonically_increasing_id()), "links")
    width_b = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    counts = settle(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a_id = F.floor(F.col("pair") / width_b).cast("int")
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))  # a row per id of A at most
    judged = settle(counts.withColumn("a", a_id).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "pair-best")
    most = (counts.agg(F.sum("n")).first()[0] or 0) // COMMON
    each = linked.select(F.col(row).alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    common = each.join(F.broadcast(judged.where(F.col("n") > most)), "pair", "left")
    rare = common.where(F.col("n").isNull()).select("row", "pair", "times").join(judged.where(F.col("n") <= most), "pair")
    sums = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = [x.groupBy("row").agg(*sums) for x in (common.where(F.col("n").isNotNull()), rare)]
    totals = parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = [c for c in linked.columns if c not in ("pairs", "times", "groups_sha256", row)]
    met = linked.drop("pairs", "times").join(totals.withColumnRenamed("row", row), row, "left")
    return met.select(*own, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
