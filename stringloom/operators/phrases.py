"""LZ phrases as tables: parsing whole texts, and reading characters out of phrases without decoding a text.

A greedy parse runs along its text, so a text is parsed where its row is, by a short scan.
Where strings of up to HEAD characters stand first is known for all positions of many texts
from one sort. Only a match beyond that is looked for in the text, from the place of the last
shorter one on, as the first place of a longer match can't come before it. Texts are dealt out
over the tasks and nothing is shuffled.

Reading out is a join: a phrase is filed under every block of positions that it touches, a
position asks the phrase of its block and moves to the phrase's source, until it stands on a
literal. Blocks bound the rows that meet under one key, however long the text.

Where a text is parsed for what it is asked alone, its phrases stay in the task and positions move
among them in numpy (`agree_in_rows`): only texts and patterns are shuffled.

Phrases are (text_id, ord, dst, src, len, ch): `len` characters from `src`, written at `dst`,
and a literal, which is empty where a last phrase reaches the end; src is 0 where len is 0.
Null and empty texts have no phrases. text_id is a key; other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import pairwise
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import common_prefix
from ..session import settle_rows, small_bytes, spread
from . import sorting

#: Positions under which phrases are filed together: a position meets all phrases of its block, so a few phrases long.
BLOCK = 16

#: Phrases of an Arrow batch.
ROWS = 100_000

#: Characters of a prefix by which the phrase ends of an LZ-End parse are kept in order.
NEAR = 64

#: Characters of the strings whose first places are known from a sort, as far as they fit.
HEAD = 8

#: Characters of a text that is sorted for that, at some 150 bytes each; longer ones are searched from their first character on.
LONG = 1 << 22

#: (dst, src, len) of each phrase.
Phrases = Iterator[tuple[int, int, int]]


def _agree(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters, up to most, a from i and b from j share."""
    k = 0
    while k < most and a[i + k : i + min(k + NEAR, most)] == b[j + k : j + min(k + NEAR, most)]:
        k = min(k + NEAR, most)
    while k < most and a[i + k] == b[j + k]:
        k += 1
    return k


#: (first place, length) of the longest match of a text from a place on, inside what may be copied.
Longest = Callable[[int], tuple[int, int]]


def _first_places(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text begins among the positions of all, and for 1, 2, ... characters from every position the first place in its text where they stand.

    None are known for a text of more than LONG characters, which is a chunk of its own.
    """
    if len(texts[0]) > LONG:
        return np.array([0, len(texts[0]) + 1]), []
    h = sorting.heads(texts, HEAD)
    order = np.argsort(h.packed, kind="stable")
    out, keys = [], h.packed[order]
    for k in range(1, h.size + 1):
        key = keys >> (h.bits * (h.size - k))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.minimum.reduceat(order, starts)
        places = np.empty(len(order), np.int32)
        places[order] = np.repeat(h.at[least], np.diff(np.append(starts, len(order))))
        out.append(places)
    return h.first, out


def _known(places: list[np.ndarray], limits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(length, first place) from every position of the longest match before its limit, as far as the sort knows it."""
    n = len(places[0]) if places else 0
    size, at = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for k, first in enumerate(places, 1):
        inside = first <= limits - k
        size += inside
        at = np.where(inside, first, at)
    return size, at


def _finder(text: str, known: tuple[list[int], list[int]] | tuple[np.ndarray, np.ndarray], base: int, most: int, limit: int | None) -> Longest:
    """The longest matches inside text[:limit], or before each place; those of `most` characters may go on. The text begins at `base` of what is known."""
    sizes, places = known
    n = len(text)

    def longest(i: int) -> tuple[int, int]:
        end = i if limit is None else limit
        if most:
            k, f = int(sizes[base + i]), int(places[base + i])
        else:
            f = text.find(text[i], 0, end)
            k, f = int(f >= 0), max(f, 0)
        if k < max(most, 1):
            return f, k
        while True:
            k += _agree(text, f + k, text, i + k, min(n - i, end - f) - k)
            at = text.find(text[i : i + k + 1], f + 1, end) if i + k < n else -1
            if at < 0:
                return f, k
            f, k = at, k + 1

    return longest


def _greedy(longest: Longest, start: int, n: int) -> Phrases:
    i = start
    while i < n:
        f, k = longest(i)
        yield i - start, f, k
        i += k + 1


def _lz_end(text: str, longest: Longest) -> Phrases:
    """As greedily, but a copy ends where an earlier phrase ended; the ends are in order of what stands before them, read backwards."""
    i, ends = 0, []
    while i < len(text):
        source, k = 0, longest(i)[1]
        while k:
            wanted = text[i : i + k][::-1]
            for back, e in ends[bisect_left(ends, (wanted[:NEAR], -1)) :]:
                if not back.startswith(wanted[:NEAR]):
                    break
                if k <= e and text[e - k : e] == text[i : i + k]:
                    source = e - k
                    break
            else:
                k -= 1
                continue
            if back.startswith(wanted[:NEAR]):
                break
            k -= 1
        yield i, source, k
        i += k + 1
        insort(ends, (text[max(0, i - NEAR) : i][::-1], i))


def _size(n: int, prefix: int, phrases: int, bits: int) -> int:
    """Bits of a text of n characters: its prefix as it stands, phrase borders, and phrases of a place and a character."""
    return int(prefix * bits + phrases * (2 + log2(n / phrases) + max(prefix - 1, 1).bit_length() + bits))


def _phrase_count(text: str, places: list[np.ndarray], prefix: int) -> int:
    """How many phrases of the text's prefix follow it."""
    most = len(places)
    size, at = _known(places, prefix)
    longest = _finder(text, (size, at), 0, most, prefix)
    if not most:
        return sum(1 for _ in _greedy(longest, prefix, len(text)))
    # where the next phrase begins; none where the match may go on beyond what is known
    after = np.where(size < most, np.arange(1, len(size) + 1) + size, 0).tolist()
    n, i, phrases = len(text), prefix, 0
    while i < n:
        i = after[i] or i + longest(i)[1] + 1
        phrases += 1
    return phrases


def _prefix_length(text: str, places: list[np.ndarray], bits: int, growth: float) -> int:
    """The length of the text's prefix to serve as its reference: grown as long as the estimate falls."""
    n = len(text)
    prefix, best, least = min(1 << 20, n // 1024 + 1), n, float("inf")
    while prefix < n:
        phrases = _phrase_count(text, places, prefix)
        size = _size(n, prefix, phrases, bits)
        if size > least:
            break
        if size < least:
            best, least = prefix, size
        prefix = max(prefix + 1, int(growth * prefix))
    return best


def parses(texts: list[str], starts: list[int] | None = None, *, ends: bool = False) -> Iterator[list[tuple[int, int, int]]]:
    """The phrases of each text, copied from before; with starts, those of what follows them, copied from what comes before them."""
    first, places = _first_places(texts)
    limits = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first)) if starts is None else np.repeat(starts, np.diff(first))
    known = tuple(c.tolist() for c in _known(places, limits))
    for i, (text, base) in enumerate(zip(texts, first.tolist())):
        longest = _finder(text, known, base, len(places), None if starts is None else starts[i])
        yield list(_lz_end(text, longest) if ends else _greedy(longest, starts[i] if starts else 0, len(text)))


def _parsed(rows: DataFrame, *, ends: bool = False) -> DataFrame:
    """Phrases of each row's text, copied from before, or where there is one, from its reference."""
    referred = "reference" in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column(1).to_pylist(), [0] * batch.num_rows
            if referred:
                references = batch.column(2).to_pylist()
                texts, starts = [r + t for r, t in zip(references, texts)], [len(r) for r in references]
            for first, some in sorting.chunks(texts):
                sizes, triples, letters = [], [], []
                for text, start, found in zip(some, starts[first:], parses(some, starts[first : first + len(some)] if referred else None, ends=ends)):
                    sizes.append(len(found))
                    triples += found
                    letters += [text[start + dst + size : start + dst + size + 1] for dst, _, size in found]
                row = np.repeat(np.arange(len(sizes)), sizes)
                number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                numbers = (pa.array(c, pa.int32()) for c in (number, *np.array(triples, np.int32).reshape(-1, 3).T))
                table = pa.table([batch.column(0).take(pa.array(row + first)), *numbers, pa.array(letters, pa.string())], ["text_id", "ord", "dst", "src", "len", "ch"])
                yield from table.to_batches(max_chunksize=ROWS)

    numbers = [T.StructField(n, T.IntegerType()) for n in ("ord", "dst", "src", "len")]
    return spread(rows, "text_id").mapInArrow(work, T.StructType([T.StructField("text_id", rows.schema["text_id"].dataType), *numbers, T.StructField("ch", T.StringType())]))


def _held(texts: DataFrame, text_id: str, text: str, *more: Column) -> DataFrame:
    return texts.where(F.length(text) > 0).select(F.col(text_id).alias("text_id"), F.col(text).alias("text"), *more)


def lz77(texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """Phrases copied from earlier text, from its first place and not overlapping themselves."""
    return _parsed(_held(texts, text_id, text))


def lz_end(texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """Phrases whose copies end where an earlier phrase ends, its literal included; the longest such copy, from any of its places."""
    return _parsed(_held(texts, text_id, text), ends=True)


def relative(texts: DataFrame, text_id: str = "text_id", text: str = "text", reference: str = "reference") -> DataFrame:
    """Phrases copied from the first place in each row's reference; a null or empty reference gives literals only."""
    return _parsed(_held(texts, text_id, text, F.coalesce(F.col(reference), F.lit("")).alias("reference")))


def prefix_lengths(texts: DataFrame, text_id: str = "text_id", text: str = "text", *, bits: int = 8, growth: float = 2.0) -> DataFrame:
    """(text_id, text, prefix): the prefix of each text to serve as its reference, of `bits` a character.

    It starts from a 1024th of the text, at most 2**20 characters, and grows by `growth` as
    long as the estimated size falls.
    """
    held = _held(texts, text_id, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, some in sorting.chunks(batch.column(1).to_pylist()):
                first, places = _first_places(some)
                sizes = [_prefix_length(text, [p[a:b] for p in places], bits, growth) for text, (a, b) in zip(some, pairwise(first.tolist()))]
                yield batch.slice(row, len(some)).append_column("prefix", pa.array(sizes, pa.int32()))

    return spread(held, "text_id").mapInArrow(work, T.StructType([*held.schema.fields, T.StructField("prefix", T.IntegerType())]))


def relative_to_prefix(prefixed: DataFrame) -> DataFrame:
    """Phrases of what follows each text's prefix, copied from the prefix; dst counts from the prefix's end."""
    rest = prefixed.select("text_id", F.substring("text", F.col("prefix") + 1, F.length("text")).alias("rest"), F.substring("text", F.lit(1), F.col("prefix")).alias("reference"))
    return relative(rest, "text_id", "rest", "reference")


def decode_relative(phrases: DataFrame, references: DataFrame, text_id: str = "text_id", reference: str = "reference") -> DataFrame:
    """(text_id, text) from relative phrases and the references (text_id, reference)."""
    spelled = phrases.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("ord", "src", "len", "ch"))).alias("ps"))
    met = spelled.join(references.select(F.col(text_id).alias("text_id"), F.col(reference).alias("_reference")), "text_id")
    part = lambda x: F.concat(F.substring("_reference", x["src"] + 1, x["len"]), x["ch"])
    return met.select("text_id", F.array_join(F.transform("ps", part), "").alias("text"))


def filed(phrases: DataFrame) -> DataFrame:
    """Settled phrases by the blocks of positions that they touch, for `extract` and what rests on it."""
    last = F.col("dst") + F.col("len") + F.length("ch") - 1
    blocks = F.sequence(F.floor(F.col("dst") / BLOCK), F.floor(last / BLOCK))
    return settle_rows(phrases.select("text_id", F.explode(blocks).alias("block"), "dst", "src", "len", "ch"), "phrases")


def extract(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(text_id, pos, ch, height) for each distinct (text_id, pos) of `asked` that lies in its text.

    The height is 1 for a literal and one more for every copy on the way to it. A step of all
    positions is a join; there are as many steps as the largest height.
    """
    state = asked.select("text_id", F.col("pos").cast("int").alias("pos")).distinct().withColumn("at", F.col("pos"))
    height, out = 0, None
    while True:
        height += 1
        met = state.withColumn("block", F.floor(F.col("at") / BLOCK)).join(index, ["text_id", "block"])
        met = met.where((F.col("at") >= F.col("dst")) & (F.col("at") < F.col("dst") + F.col("len") + F.length("ch")))
        literal = F.col("at") == F.col("dst") + F.col("len")
        moved = settle_rows(met.select("text_id", "pos", (F.col("src") + F.col("at") - F.col("dst")).alias("at"), F.when(literal, F.col("ch")).alias("ch")), "extract")
        ended = moved.where("ch is not null").select("text_id", "pos", "ch", F.lit(height).alias("height"))
        out = ended if out is None else out.unionByName(ended)
        state = moved.where("ch is null").select("text_id", "pos", "at")
        if not state.limit(1).count():
            return out


def display(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows (text_id, start, end, ...) of `asked` with the characters start to end, both included, as `shown`.

    Cut at the text's ends; empty where nothing of it lies in the text, null where start > end
    or one is null.
    """
    spans = asked.select("text_id", "start", "end").where(F.col("start") <= F.col("end")).distinct()
    each = spans.select("text_id", "start", "end", F.explode(F.sequence(F.greatest("start", F.lit(0)), F.greatest("end", F.lit(0)))).alias("pos"))
    each = settle_rows(each.where(F.col("pos") <= F.col("end")), "spans")
    letters = each.join(extract(index, each), ["text_id", "pos"]).groupBy("text_id", "start", "end")
    shown = letters.agg(F.sort_array(F.collect_list(F.struct("pos", "ch"))).alias("cs")).select("text_id", "start", "end", F.array_join(F.transform("cs", lambda c: c["ch"]), "").alias("_shown"))
    met = asked.drop("shown").hint("merge").join(shown, ["text_id", "start", "end"], "left")
    return met.withColumn("shown", F.when(F.col("start") <= F.col("end"), F.coalesce("_shown", F.lit("")))).drop("_shown")


def agree(index: DataFrame, asked: DataFrame, *, backwards: bool = False, first: int = 16) -> DataFrame:
    """(id, n): how far, for each row (id, text_id, t, pattern, p), pattern from p and the text from t agree; backwards, up to p and t, both included.

    Windows of the text are read out, each four times as long as the one before, for the rows
    that agree in all of the last one. id is a key; positions outside a side agree in nothing.
    """
    left = F.col("p") + 1 if backwards else F.length("pattern") - F.col("p")
    inside = (F.col("p") >= 0) & (F.col("p") < F.length("pattern")) & (F.col("t") >= 0)
    state = asked.select("id", "text_id", "t", F.when(inside, left).otherwise(0).cast("int").alias("left"), "pattern", "p", F.lit(0).alias("n"))
    out, width = None, first
    while True:
        span = F.least(F.col("left") - F.col("n"), F.lit(width), *([F.col("t") - F.col("n") + 1] if backwards else []))
        far = F.col("t") - F.col("n") if backwards else F.col("t") + F.col("n")
        want = state.withColumn("span", span).withColumn("start", far - F.col("span") + 1 if backwards else far).withColumn("end", far if backwards else far + F.col("span") - 1)
        seen = display(index, want)
        begin = F.col("p") - F.col("n") - F.col("span") + 2 if backwards else F.col("p") + F.col("n") + 1
        part = F.substring("pattern", begin, F.col("span"))
        same = common_prefix(F.reverse(part), F.reverse("shown")) if backwards else common_prefix(part, F.col("shown"))
        whole = (F.length("shown") == F.col("span")) if backwards else F.lit(True)  # else t lies behind the text
        stepped = settle_rows(seen.withColumn("k", F.when((F.col("span") > 0) & whole, same).otherwise(0)).select("id", "text_id", "t", "left", "pattern", "p", (F.col("n") + F.coalesce("k", F.lit(0))).alias("n"), (F.col("k") == width).alias("on")), "agree")
        more = F.coalesce("on", F.lit(False)) & (F.col("n") < F.col("left"))
        ended = stepped.where(~more).select("id", "n")
        out = ended if out is None else out.unionByName(ended)
        state = stepped.where(more).drop("on")
        if not state.limit(1).count():
            return out
        width *= 4


def lcs_char(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, lcs, char): `agree` backwards with the text's character that ends the match, null where a start was reached."""
    found = asked.join(agree(index, asked, backwards=True), "id")
    stop = settle_rows(found.select("id", "text_id", F.col("n").alias("lcs"), F.when((F.col("n") <= F.col("p")) & (F.col("n") <= F.col("t")), F.col("t") - F.col("n")).cast("int").alias("pos")), "stops")
    letters = extract(index, stop.where("pos is not null")).select("text_id", "pos", F.col("ch").alias("char"))
    return stop.join(letters, ["text_id", "pos"], "left").select("id", "lcs", "char")


class _Read:
    """Characters read out of the phrases of some texts, whose positions count through all of them."""

    def __init__(self, texts: list[str]):
        self.first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        triples, counts, letters = [], [], []
        for text, found in zip(texts, parses(texts), strict=True):
            counts.append(len(found))
            triples += found
            letters += [text[dst + size : dst + size + 1] for dst, _, size in found]
        base = np.repeat(self.first[:-1], counts)
        dst, src, self.held = np.array(triples, np.int64).reshape(-1, 3).T
        self.dst, self.src, self.letters = dst + base, src + base, _points([c or "\0" for c in letters])

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        out, at, left = np.zeros(len(asked), np.uint32), asked, np.arange(len(asked))
        while len(left):
            phrase = np.searchsorted(self.dst, at, "right") - 1
            literal = at == self.dst[phrase] + self.held[phrase]
            out[left[literal]] = self.letters[phrase[literal]]
            at, left = (self.src[phrase] + at - self.dst[phrase])[~literal], left[~literal]
        return out


def _points(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)


def agree_in_rows(rows: DataFrame, *, first: int = 16) -> DataFrame:
    """(text_id, found) of the rows (text_id, text, pattern, asked): for each (t, p, back) of asked, in its order, how far (n) pattern from p and the text from t agree, backwards where back holds, both included, and the text's character (char) that ends the match.

    As `agree` and `lcs_char`, by the LZ77 phrases of the row's own text. The character is null where a side ends, and
    for positions outside a side, which agree in nothing.
    """
    held = rows.where((F.length("text") > 0) & F.col("text_id").isNotNull())
    held = held.select("text_id", "text", F.coalesce("pattern", F.lit("")).alias("pattern"), *(F.transform(f"asked.{c}", lambda x: F.coalesce(x.cast("int"), F.lit(-1))).alias(c) for c in ("t", "p", "back")))

    def found(texts: list[str], patterns: list[str], row: np.ndarray, t: np.ndarray, p: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        read, points = _Read(texts), _points(patterns)
        sizes, starts = np.array([len(x) for x in patterns], np.int64), np.diff(read.first) - 1
        begins, n = (np.cumsum(sizes) - sizes)[row], np.zeros(len(row), np.int64)
        inside = (p >= 0) & (p < sizes[row]) & (t >= 0) & (t < starts[row])
        left = np.where(inside, np.where(back, np.minimum(p, t) + 1, np.minimum(sizes[row] - p, starts[row] - t)), 0)
        step, at, width = np.where(back, -1, 1), read.first[row] + t, first
        on = np.flatnonzero(left > 0)
        while len(on):
            span = np.minimum(left[on] - n[on], width)
            ends = np.cumsum(span)
            k = np.arange(ends[-1]) - np.repeat(ends - span, span)
            own = np.repeat(on, span)
            far = step[own] * (n[own] + k)
            same = read(at[own] + far) == points[begins[own] + p[own] + far]
            matched = np.minimum.reduceat(np.where(same, np.repeat(span, span), k), ends - span)
            n[on] += matched
            on = on[(matched == span) & (n[on] < left[on])]
            width *= 4
        stopped = np.flatnonzero(n < left)
        chars = np.full(len(row), None, object)
        chars[stopped] = [chr(c) for c in read(at[stopped] + step[stopped] * n[stopped])]
        return n, pa.array(chars, pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in sorting.chunks(batch.column(1).to_pylist()):
                some = batch.slice(begin, len(texts))
                counts = pc.fill_null(pc.list_value_length(some.column(3)), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(texts)), counts)
                t, p, back = (some.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5))
                n, chars = found(texts, some.column(2).to_pylist(), row, t, p, back == 1)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                each = pa.StructArray.from_arrays([pa.array(n, pa.int32()), chars], ["n", "char"])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, each)], ["text_id", "found"])

    small_bytes(rows.sparkSession)
    answers = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("char", T.StringType())]))
    return spread(held, "text_id").mapInArrow(work, T.StructType([held.schema["text_id"], T.StructField("found", answers)]))


def nesting(phrases: DataFrame) -> DataFrame:
    """(text_id, ord, depth): in how many nested sources, at most, each phrase's source lies; from 0, equal sources alike, null without a copy.

    One interval lies in another if that one is longer and covers it. In order of their starts,
    longer ones first, a chain of nested intervals is a sequence of ends that don't rise.
    """

    def depths(spans: list[tuple[int, int]]) -> list[int | None]:
        depth, tails = {}, []
        for src, size in sorted({s for s in spans if s[1]}, key=lambda s: (s[0], -s[1])):
            end = -(src + size)
            depth[src, size] = bisect_right(tails, end)
            tails[depth[src, size] : depth[src, size] + 1] = [end]
        return [depth.get(s) for s in spans]

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = table["text_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        spans, out = list(zip(table["src"].to_pylist(), table["len"].to_pylist(), strict=True)), []
        borders = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for first, last in pairwise(borders):
            out += depths(spans[first:last])
        yield from table.select(["text_id", "ord"]).append_column("depth", pa.array(out, pa.int32())).combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows whose last text may go on in the next batch
        for batch in batches:
            if held and batch.num_rows and batch.column(0)[0] != held[-1].column(0)[-1]:
                yield from told(pa.Table.from_batches(held))
                held = []
            if batch.num_rows:
                ids = batch.column(0)
                codes = ids.dictionary_encode().indices.to_numpy()
                cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if codes[0] != codes[-1] else 0
                if cut:
                    yield from told(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield from told(pa.Table.from_batches(held))

    own = phrases.select("text_id", "ord", "src", "len")
    schema = T.StructType([own.schema["text_id"], own.schema["ord"], T.StructField("depth", T.IntegerType())])
    return spread(own, "text_id").sortWithinPartitions("text_id").mapInArrow(work, schema)
