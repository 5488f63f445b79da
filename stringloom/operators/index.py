"""The search index as tables: sA, opt-sA and PA variants, stored as Parquet; look-ups, locate-one, longest prefixes and MEMs.

sA holds the positions of the suffixient set, PA every prefix, opt-sA the set of sA with keys
as long as a budget of space allows. Entries are ordered by character, then
co-lexicographically. The stored key is an entry's last characters, reversed, so that
co-lexicographic search is a comparison of strings. Entries of one key are a group, whose
first entry is its leader.

An index is made where its text's row is: `in_rows` gives a text's places in order in one
array, and keys are read off the text. `build` lists the entries with their keys as rows, to
be stored. What is asked of a text lies in its row as well when it is searched, so that only
texts and patterns are shuffled, never entries, keys or ends of patterns.

A search has two levels: an as-of step among the keys, and, where the whole key agrees, a
binary search inside the group by the texts, in pieces of twice the length each. It gives the
entry whose prefix shares the longest suffix with the pattern up to there. The matching
statistics take one walk along the pattern: a match goes on while the text does, and where it
stops, the longest match is the entry's, as a text that goes on in two ways has an entry for
each.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import let
from ..session import settle, settle_rows, spread
from . import sorting, suffix
from .suffixient import chosen_in, from_suffixes

VARIANTS = ("sA", "opt-sA", "PA")
KEY, LEAST_KEY, LONGEST_KEY = 14, 5, 16


def key_length(n: int, entries: int, variant: str = "sA", extra_percent: float = 30) -> int:
    """How many characters a key stores: KEY, or for opt-sA as many as the space budget allows, within bounds.

    The budget is extra_percent of the entries at two bits plus their rank's share each.
    """
    if variant != "opt-sA" or not entries:
        return KEY
    import math

    budget = extra_percent / 100 * entries * max(1, math.ceil(math.log2(max(2, n))))
    length = LEAST_KEY
    while length < LONGEST_KEY and entries * (2 + max(0.0, (length + 1) * 2 - math.log2(entries))) <= budget:
        length += 1
    return length


def _places(rows: DataFrame, variant: str) -> DataFrame:
    """The rows (text_id, text, ...) with `places`: the positions of their text's entries, in order; none for a null or empty text."""
    schema = T.StructType([*rows.schema.fields, T.StructField("places", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in sorting.chunks([t or "" for t in batch.column("text").to_pylist()]):
                own = [i for i, t in enumerate(texts) if t]
                sizes, at = np.zeros(len(texts), np.int64), np.empty(0, np.int64)
                if own:
                    s = sorting.sort([texts[i][::-1] for i in own], suffix.WIDTH)
                    row, at = (s.row[s.rank > 0], (s.lengths[s.row] - 1 - s.sa)[s.rank > 0]) if variant == "PA" else chosen_in(s)[0:4:3]
                    sizes[own] = np.bincount(row, minlength=len(own))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                places = pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, places], names=schema.names)

    length = F.coalesce(F.length("text"), F.lit(0))
    out = spread(rows.where(length <= suffix.LONG), "text_id").mapInArrow(work, schema)
    long = rows.where(length > suffix.LONG)
    if not long.limit(1).count():
        return out
    ordered = settle_rows(suffix.joined(suffix.reversed_texts(long), suffix.WIDTH), "suffixes")
    if variant == "PA":
        entries = suffix.prefix_array(ordered).select("text_id", F.struct(F.lit("").alias("ch"), "rank", F.col("end").alias("pos")).alias("e"))
    else:
        entries = from_suffixes(ordered).select("text_id", F.struct("ch", "rank", "pos").alias("e"))
    listed = entries.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["pos"]).alias("places"))
    return out.unionByName(long.join(listed, "text_id"))


def in_rows(rows: DataFrame, variant: str = "sA", *, key: int | None = None, extra_percent: float = 30) -> DataFrame:
    """The rows (text_id, text, ...) with the index of their text: `places` in order, and `stored`, the length of keys.

    stored is KEY by default; for opt-sA what key_length makes of extra_percent over all
    texts, for which the rows are settled.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; one of {', '.join(VARIANTS)}")
    placed = _places(rows, variant)
    if key is None and variant == "opt-sA":
        placed = settle(placed, "index", compression="zstd")
        n, entries = placed.where(F.length("text") > 0).agg(F.sum(F.length("text").cast("long") + 1), F.sum(F.size("places").cast("long"))).first()
        key = key_length(n or 0, entries or 0, variant, extra_percent)
    return placed.withColumn("stored", F.lit(key or KEY))


def _keys(text: str, places: list[int], width: int) -> list[str]:
    """The `width` characters up to each place, reversed."""
    back, last = text[::-1], len(text) - 1
    return [back[last - p : last - p + width] for p in places]


def build(texts: DataFrame, variant: str = "sA", *, text_id: str = "text_id", text: str = "text", key: int | None = None, extra_percent: float = 30) -> DataFrame:
    """(text_id, ord, ch, pos, key, group, leader, stored): the index of each text, from `in_rows`.

    group numbers a text's distinct keys, leader marks the first entry of each.
    """
    own = texts.where(F.col(text_id).isNotNull()).select(F.col(text_id).alias("text_id"), F.col(text).alias("text"))
    ints = {c: T.IntegerType() for c in ("ord", "pos", "group", "stored")}
    kinds = ints | {"ch": T.StringType(), "key": T.StringType(), "leader": T.BooleanType()}
    names = ["ord", "ch", "pos", "key", "group", "leader", "stored"]

    def entries(first: int, texts: list[str], places: list[list[int]], widths: list[int], ids: pa.Array) -> pa.Table:
        sizes = np.array([len(p) for p in places])
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = pa.array([k for t, p, w in zip(texts, places, widths) for k in _keys(t, p, w)], pa.string())
        ord_ = np.arange(len(starts)) - starts
        leader = ord_ == 0
        leader[1:] |= pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(leader)
        columns = {"ord": ord_, "ch": pc.utf8_slice_codeunits(keys, 0, 1), "pos": [x for p in places for x in p], "key": keys, "group": group - group[starts], "leader": leader, "stored": np.repeat(widths, sizes)}
        return pa.table([ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes) + first)), *(pa.array(columns[c], pa.int32()) if c in ints else pa.array(columns[c]) if c == "leader" else columns[c] for c in names)], ["text_id", *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, widths = batch.column("text").to_pylist(), batch.column("stored").to_pylist()
            for first, some in sorting.chunks([t or "" for t in held]):
                places = batch.column("places").slice(first, len(some)).to_pylist()
                if any(places):
                    yield from entries(first, some, places, widths[first : first + len(some)], batch.column("text_id")).to_batches(max_chunksize=suffix.ROWS)

    schema = T.StructType([T.StructField("text_id", own.schema["text_id"].dataType), *(T.StructField(c, kinds[c]) for c in names)])
    return in_rows(own, variant, key=key, extra_percent=extra_percent).mapInArrow(work, schema)


def store(index: DataFrame, path: str, *, replace: bool = False) -> None:
    """Write the index, clustered by text and character so that look-ups skip files; an existing path is refused unless replaced."""
    index.repartition("text_id").sortWithinPartitions("text_id", "ch", "key").write.mode("overwrite" if replace else "errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_bytes(index: DataFrame) -> DataFrame:
    """(text_id, entries, bytes): entries and what their keys and positions amount to."""
    return index.groupBy("text_id").agg(F.count("*").alias("entries"), F.sum(F.octet_length("key") + 8).alias("bytes"))


class _Searched:
    """A text with its index, while patterns are looked for in it."""

    def __init__(self, text: str, places: list[int], width: int):
        self.text, self.back, self.last = text, text[::-1], len(text) - 1
        self.places, self.width, self.keys = places, width, _keys(text, places, width)

    def nearest(self, asked: str, start: int) -> tuple[int, int]:
        """(matched, pos): the entry whose prefix, read backwards, agrees longest with the reversed pattern `asked` from `start` on; (0, -1) if none does."""
        keys, places, width = self.keys, self.places, self.width
        wanted = asked[start : start + width]
        at = bisect_left(keys, wanted)
        if at == len(keys) or len(wanted) < width or keys[at] != wanted:
            return self._better(at, 0, len(keys), 0, lambda i: keys[i], wanted)
        # the whole key agrees: the rest is looked up among the group's members, in their order
        low, high, done, step = at, bisect_right(keys, wanted, at), width, width
        while True:
            piece = lambda p, done=done, step=step: self.back[self.last - p + done : self.last - p + done + step]
            wanted = asked[start + done : start + done + step]
            at = bisect_left(places, wanted, low, high, key=piece)
            if len(wanted) < step or at == high or piece(places[at]) != wanted:
                return self._better(at, low, high, done, lambda i: piece(places[i]), wanted)
            low, high, done, step = at, bisect_right(places, wanted, at, high, key=piece), done + step, 2 * step

    def _better(self, at: int, low: int, high: int, done: int, piece: Callable[[int], str], wanted: str) -> tuple[int, int]:
        """Of the entries just below and just above, the one that shares more; `done` characters agree in all from low to high."""
        best = (0, -1)
        for i in (at - 1, at):
            if low <= i < high:
                k = 0
                for a, b in zip(piece(i), wanted):
                    if a != b:
                        break
                    k += 1
                if done + k > best[0]:
                    best = done + k, self.places[i]
        return best

    def ends(self, seq: str) -> Iterator[tuple[int, int]]:
        """`nearest` for every end in a pattern."""
        asked = seq[::-1]
        return (self.nearest(asked, start) for start in range(len(seq) - 1, -1, -1))

    def tail(self, seq: str) -> Iterator[tuple[int, int]]:
        yield self.nearest(seq[::-1], 0)

    def statistics(self, seq: str) -> Iterator[tuple[int, int]]:
        """(len, pos) for every end in a pattern: the longest match that ends there and where it ends in the text."""
        asked, text, last, start = seq[::-1], self.text, self.last, len(seq)
        size, pos = 0, -1
        for ch in seq:
            start -= 1
            if size and pos < last and text[pos + 1] == ch:
                size, pos = size + 1, pos + 1
            else:
                size, pos = self.nearest(asked, start)
            yield size, pos

    def whole(self, seq: str) -> Iterator[tuple[int, int]]:
        """The last of the statistics."""
        found = (0, -1)
        for found in self.statistics(seq):
            pass
        yield found


#: What a pattern is asked, and whether the answer is one (len, pos) or one for every end.
_SEARCHES = {"ends": True, "tail": False, "statistics": True, "whole": False}

#: Answers that a task gathers before it hands them on.
ANSWERS = 1 << 20


def search(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of `in_rows` with `found`: what comes of each pattern in asked, an array of (pattern_id, seq), in its order.

    kind: `ends`, `tail`, `statistics` or `whole`. An answer is (len, pos), pos being where the
    match ends in the text, (0, -1) for none; `ends` and `statistics` have one for every end in
    the pattern. Null and empty patterns have the answer null.
    """
    each = _SEARCHES[kind]
    answer = T.StructType([T.StructField("len", T.IntegerType()), T.StructField("pos", T.IntegerType())])
    schema = T.StructType([*rows.schema.fields, T.StructField("found", T.ArrayType(T.ArrayType(answer) if each else answer))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            seqs = iter(lists.flatten().field("seq").to_pylist())
            texts, widths = batch.column("text").to_pylist(), batch.column("stored").to_pylist()
            first, sizes, lengths, spots, known, total = 0, [], array("i"), array("i"), [], 0

            def full(end: int) -> pa.RecordBatch:
                values = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, np.int32) if x else [], pa.int32()) for x in (lengths, spots)], names=["len", "pos"])
                mask = pa.array([not k for k in known], pa.bool_())
                if each:
                    values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=mask)
                else:
                    values = pa.StructArray.from_arrays([values.field(0), values.field(1)], names=["len", "pos"], mask=mask)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[first:end])]), pa.int32()), values)
                return pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, found], names=schema.names)

            for row, text in enumerate(texts):
                asked = [next(seqs) for _ in range(counts[row])]
                held = _Searched(text or "", batch.column("places")[row].as_py() or [], widths[row]) if any(asked) else None
                for seq in asked:
                    before = len(lengths)
                    for size, pos in getattr(held, kind)(seq) if seq else () if each else ((0, -1),):
                        lengths.append(size)
                        spots.append(pos)
                    sizes.append(len(lengths) - before)
                    known.append(bool(seq))
                total += len(text or "")
                if len(lengths) + total >= ANSWERS:
                    yield full(row + 1)
                    first, sizes, lengths, spots, known, total = row + 1, [], array("i"), array("i"), [], 0
            if first < len(texts):
                yield full(len(texts))

    return rows.mapInArrow(work, schema)


def answers(found: DataFrame, *more: str) -> DataFrame:
    """(pattern_id, text_id, seq, found, more): the rows of `search` by pattern, without null and empty ones."""
    zipped = found.select("text_id", *more, F.inline(F.arrays_zip("asked", "found")).alias("_asked", "found"))
    return zipped.where("found is not null").select("_asked.pattern_id", "text_id", "_asked.seq", "found", *more)


def _asked(index: DataFrame, pairs: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """(pattern_id, text_id, seq, found, text): `answers` to pairs (pattern_id, text_id, seq), from the entries of an index."""
    entries = F.array_sort(F.collect_list(F.struct("ord", "pos")))
    packed = index.groupBy("text_id").agg(F.transform(entries, lambda e: e["pos"]).alias("places"), F.first("stored").alias("stored"))
    wanted = pairs.where(F.length("seq") > 0).groupBy("text_id").agg(F.collect_list(F.struct("pattern_id", "seq")).alias("asked"))
    rows = wanted.join(texts.select("text_id", "text"), "text_id").join(packed, "text_id", "left")
    return answers(search(rows.withColumn("stored", F.coalesce("stored", F.lit(KEY))), kind), "text")


def nearest(index: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, text_id, end, pos, matched): for every end in a pattern, the entry whose prefix shares the longest suffix with the pattern up to there.

    pairs: (pattern_id, text_id, seq), each pair of ids once; texts: (text_id, text). An end
    whose character has no entry in the text has the place -1 and matches 0. Nulls and empty
    patterns give no rows.
    """
    each = _asked(index, pairs, texts, "ends").select("pattern_id", "text_id", F.posexplode("found").alias("end", "f"))
    return each.select("pattern_id", "text_id", "end", "f.pos", F.col("f.len").alias("matched"))


def matching_statistics(index: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, text_id, stats): for every end in a pattern (len, pos), the longest match that ends there and where it ends in the text.

    Patterns that are null or empty, and texts that are null, empty or unknown, give no row;
    a character that the text lacks has the length 0 and the place -1.
    """
    return _asked(index, pairs, texts.where(F.length("text") > 0), "statistics").select("pattern_id", "text_id", F.col("found").alias("stats"))


def maximal(stats: Column) -> Column:
    """(start, len, text_pos) of the maximal exact matches, from a pattern's statistics; (start, 0, -1) for characters that the text lacks."""

    def kept(all_: Column) -> Column:
        each = F.transform(all_, lambda x, i: F.struct(i.alias("end"), x["len"].alias("len"), x["pos"].alias("pos")))
        return F.filter(each, lambda x: (x["len"] == 0) | F.coalesce(F.get(all_, x["end"] + 1)["len"] <= x["len"], F.lit(True)))

    def match(m: Column) -> Column:
        found = m["len"] > 0
        return F.struct(F.when(found, m["end"] - m["len"] + 1).otherwise(m["end"]).alias("start"), m["len"].alias("len"), F.when(found, m["pos"] - m["len"] + 1).otherwise(-1).alias("text_pos"))

    return F.transform(let(stats, kept), match)


def mems(stats: DataFrame) -> DataFrame:
    """(pattern_id, text_id, start, len, text_pos): the maximal exact matches, from matching_statistics; (start, 0, -1) for characters that the text lacks."""
    return stats.select("pattern_id", "text_id", F.inline(maximal(F.col("stats"))))


def longest_prefix(index: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, text_id, pos, matched, stop): where a prefix of the text ends that shares the longest suffix with the pattern.

    By one look-up of each pattern's end. pos is -1 and matched 0 where the last character has
    no entry; stop is the text's character that ends the match, null where the text starts there.
    """
    found = _asked(index, pairs, texts, "tail").where("found.len > 0")
    at = F.col("pos") - F.col("matched")
    known = found.select("pattern_id", "text_id", "found.pos", F.col("found.len").alias("matched"), "text").select("pattern_id", "text_id", "pos", "matched", F.when(at >= 0, F.substring("text", at + 1, F.lit(1))).alias("stop"))
    return pairs.where(F.length("seq") > 0).select("pattern_id", "text_id").join(known, ["pattern_id", "text_id"], "left").na.fill({"pos": -1, "matched": 0})


def locate_one(index: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, text_id, pos): one occurrence of each pattern in its text; pos is -1 where it doesn't occur, is null or empty, or its text is unknown."""
    ends = _asked(index, pairs, texts, "whole")
    found = ends.where(F.col("found.len") == F.length("seq")).select("pattern_id", "text_id", (F.col("found.pos") + 1 - F.col("found.len")).alias("at"))
    return pairs.select("pattern_id", "text_id").join(found, ["pattern_id", "text_id"], "left").select("pattern_id", "text_id", F.coalesce("at", F.lit(-1)).alias("pos"))


def lookup(index: DataFrame, prefixes: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, text_id, pos): an entry of the index where each whole prefix (pattern_id, text_id, seq) ends, if there is one."""
    met = longest_prefix(index, prefixes, texts).where("matched > 0").join(prefixes.select("pattern_id", "text_id", F.length("seq").alias("n")), ["pattern_id", "text_id"])
    return met.where(F.col("matched") == F.col("n")).select("pattern_id", "text_id", "pos")
