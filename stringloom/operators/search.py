"""Batch pattern search over collections of texts: exist, count, locate all, one, some, last; MEMs; verification.

Patterns meet texts by an equi-join of seeds: a pattern's first SEED characters (or all of a
shorter one) against the characters at every text position. What meets is compared in full.
Seeds are looked up by hash and no pattern is tried on a text that doesn't hold its seed.

Null and empty patterns and texts give no occurrences; positions are 0-based characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import let
from ..session import settle
from .sorting import STEP, chunks
from .suffix import positions

SEED = 16

#: Distinct seeds up to which they go to every task; beyond, a shuffle join.
MAX_SEEDS = 1_000_000

#: Factors of the seeds' hashes.
BASE, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _hashes(points: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """The hashes of the windows of each size from every position on, of powers of two put together; beyond the end they are cut short."""
    power, width = {1: points.astype(np.uint64) * SPREAD + np.uint64(1)}, 1
    after = lambda h, k: np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])
    while width * 2 <= max(sizes):
        power[width * 2] = power[width] * np.uint64(pow(BASE, width, 1 << 64)) + after(power[width], width)
        width *= 2
    out = {}
    for size in sizes:
        done, h = 0, np.zeros(len(points), np.uint64)
        for w in (w for w in power if size & w):
            h, done = h * np.uint64(pow(BASE, w, 1 << 64)) + after(power[w], done), done + w
        out[size] = h
    return out


class Seeds:
    """Distinct seeds by size and hash, to be found in many texts at once."""

    def __init__(self, seeds: list[str]):
        self.seeds = set(seeds)
        self.sizes = sorted({len(s) for s in seeds})
        self.bits = max(16, (16 * len(seeds)).bit_length())
        self.marks = {}
        for size in self.sizes:
            own = [s for s in seeds if len(s) == size]
            h = _hashes(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32), [size])[size][::size]
            self.marks[size] = np.zeros(1 << self.bits, bool)
            self.marks[size][self._place(h)] = True

    def _place(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * SPREAD) >> np.uint64(64 - self.bits)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(which text, position, seed) of every place where a seed stands."""
        lengths = np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(lengths)])
        whole = "".join(texts)
        hashes = _hashes(np.frombuffer(whole.encode("utf-32-le"), np.uint32), self.sizes)
        at = np.concatenate([np.stack([p, np.full(len(p), s)]) for s, h in hashes.items() for p in [np.flatnonzero(self.marks[s][self._place(h)])]], axis=1)
        row = np.searchsorted(first, at[0], "right") - 1
        cut = [whole[p : p + s] for p, s in at.T.tolist()]
        inside = at[0] + at[1] <= first[row + 1]
        kept = np.flatnonzero(inside & np.array([c in self.seeds for c in cut], bool))
        return row[kept], at[0][kept] - first[row[kept]], [cut[i] for i in kept]


def places_of(seeds: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(text_id, pos, seed): every text position where one of the seeds (column seed, up to SEED characters) stands.

    The seeds' hashes reach the tasks, where the hashes of all windows of a seed's size are made
    for many texts at once, so that only positions with a seed leave their row. With more seeds,
    all positions are joined.
    """
    asked = settle(seeds.where(F.length("seed") > 0).distinct(), "seeds")
    sizes = {r["s"]: r["c"] for r in asked.groupBy(F.length("seed").alias("s")).agg(F.count("*").alias("c")).collect()}  # SEED values at most
    if not sizes or sum(sizes.values()) > MAX_SEEDS:
        keys = positions(texts, text_id, text, SEED).select("text_id", "pos", "key")
        cuts = F.filter(F.array(*(F.when(F.length("key") >= s, F.substring("key", 1, s)) for s in sorted(sizes))), lambda x: x.isNotNull()) if sizes else F.array().cast("array<string>")
        return keys.select("text_id", "pos", F.explode(cuts).alias("seed")).join(asked, "seed", "left_semi")
    table = Seeds(asked.toArrow()["seed"].to_pylist())  # MAX_SEEDS at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a long text in pieces that reach into the next one
            pieces = [(i, base, t[base : base + STEP + SEED - 1]) for i, t in enumerate(batch.column(1).to_pylist()) for base in range(0, len(t), STEP)]
            of, bases = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
            for first, held in chunks([p[2] for p in pieces]):
                row, pos, seed = table.found(held)
                own = np.flatnonzero(pos < STEP)
                row, pos = row[own] + first, pos[own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[row])), pa.array(pos + bases[row], pa.int32()), pa.array([seed[i] for i in own], pa.string())], names=["text_id", "pos", "seed"])

    own = texts.where(F.length(text) > 0).select(F.col(text_id).alias("text_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("text_id", own.schema["text_id"].dataType), T.StructField("pos", T.IntegerType()), T.StructField("seed", T.StringType())])
    return own.mapInArrow(work, schema)


def locate_all(patterns: DataFrame, texts: DataFrame, pattern_id: str = "pattern_id", seq: str = "seq", text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(pattern_id, text_id, pos, len): every occurrence, overlapping ones too."""
    asked = patterns.where(F.length(seq) > 0).select(F.col(pattern_id).alias("pattern_id"), F.col(seq).alias("seq"), F.substring(seq, 1, SEED).alias("seed"))
    met = places_of(asked.select("seed"), texts, text_id, text).join(asked, "seed")
    met = settle(met.select("pattern_id", "text_id", "pos", "seq"), "met")  # its size is known, and few places don't shuffle whole texts
    whole = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("_text"))
    found = met.where(F.length("seq") <= SEED).select("pattern_id", "text_id", "pos", F.length("seq").alias("len"))
    long = met.where(F.length("seq") > SEED).join(whole, "text_id").where(F.substring("_text", F.col("pos") + 1, F.length("seq")) == F.col("seq"))
    return found.unionByName(long.select("pattern_id", "text_id", "pos", F.length("seq").alias("len")))


def exist(patterns: DataFrame, occurrences: DataFrame, pattern_id: str = "pattern_id") -> DataFrame:
    """(pattern_id, found) for every pattern."""
    hits = occurrences.select("pattern_id", F.lit(True).alias("hit")).distinct()
    return patterns.select(F.col(pattern_id).alias("pattern_id")).join(hits, "pattern_id", "left").select("pattern_id", F.coalesce("hit", F.lit(False)).alias("found"))


def count(patterns: DataFrame, occurrences: DataFrame, pattern_id: str = "pattern_id") -> DataFrame:
    """(pattern_id, n, n_texts) for every pattern."""
    hits = occurrences.groupBy("pattern_id").agg(F.count("*").alias("n"), F.countDistinct("text_id").alias("n_texts"))
    return patterns.select(F.col(pattern_id).alias("pattern_id")).join(hits, "pattern_id", "left").na.fill(0, ["n", "n_texts"])


def locate_one(patterns: DataFrame, occurrences: DataFrame, pattern_id: str = "pattern_id", seq: str = "seq") -> DataFrame:
    """(pattern_id, text_id, pos, len): the first occurrence by text and position; pos is -1 and text_id null where there is none."""
    first = occurrences.groupBy("pattern_id").agg(F.min(F.struct("text_id", "pos")).alias("f"))
    own = patterns.select(F.col(pattern_id).alias("pattern_id"), F.length(seq).alias("len"))
    return own.join(first, "pattern_id", "left").select("pattern_id", "f.text_id", F.coalesce("f.pos", F.lit(-1)).alias("pos"), "len")


def locate_max(occurrences: DataFrame, k: int) -> DataFrame:
    """The first k occurrences of each pattern."""
    w = Window.partitionBy("pattern_id").orderBy("text_id", "pos")
    return occurrences.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def toehold(occurrences: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(pattern_id, text_id, pos): per text the occurrence that comes last in suffix order."""
    whole = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("_text"))
    suffix = F.substring("_text", F.col("pos") + 1, F.length("_text"))
    return settle(occurrences, "occurrences").join(whole, "text_id").groupBy("pattern_id", "text_id").agg(F.max_by("pos", suffix).alias("pos"))


def verify(occurrences: DataFrame, patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """The occurrences whose text differs from their pattern: none if all is well."""
    both = occurrences.join(texts.select("text_id", "text"), "text_id").join(patterns.select("pattern_id", "seq"), "pattern_id")  # few occurrences don't shuffle whole texts
    return both.where(F.substring("text", F.col("pos") + 1, F.col("len")) != F.col("seq")).select(*occurrences.columns)


def matching_statistics(pattern: Column, text: Column) -> Column:
    """For every pattern position the length of the longest match from there that occurs in the text."""

    def longest(p: Column, t: Column, i: Column) -> Column:
        def halve(state: Column, _: Column) -> Column:
            middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
            inside = F.contains(t, F.substring(p, i, middle))
            return F.struct(F.when(inside, middle).otherwise(state["low"]).alias("low"), F.when(inside, state["high"]).otherwise(middle - 1).alias("high"))

        left = F.length(p) - i + 1
        start = F.struct(F.lit(0).alias("low"), left.cast("int").alias("high"))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(left + 2)).cast("int")), start, halve, lambda s: s["low"])

    at = lambda p: F.when(F.length(p) > 0, F.sequence(F.lit(1), F.length(p))).otherwise(F.array().cast("array<int>"))
    return let(F.struct(pattern.alias("p"), text.alias("t")), lambda s: F.transform(at(s["p"]), lambda i: longest(s["p"], s["t"], i)))


def mems(pairs: DataFrame, key: str, pattern: str, text: str) -> DataFrame:
    """(key, start, len, text_pos): the maximal exact matches of each row's pattern in its text, leftmost in the text.

    A pattern character that the text lacks gives (start, 0, -1).
    """
    stats = matching_statistics(F.col(pattern), F.col(text))
    kept = let(stats, lambda ms: F.filter(F.transform(ms, lambda n, i: F.struct(i.alias("start"), n.alias("len"), F.when(i > 0, F.get(ms, i - 1)).alias("before"))), lambda x: (x["len"] == 0) | x["before"].isNull() | (x["before"] <= x["len"])))
    rows = pairs.where(F.col(pattern).isNotNull() & F.col(text).isNotNull()).select(key, pattern, text, F.explode(kept).alias("m"))
    place = F.when(F.col("m.len") > 0, F.expr(f"instr(`{text}`, substr(`{pattern}`, m.start + 1, m.len))") - 1).otherwise(-1)
    return rows.select(key, "m.start", "m.len", place.alias("text_pos"))


def longest_prefix(pairs: DataFrame, key: str, pattern: str, text: str) -> DataFrame:
    """(key, pos, matched): where a prefix of the text ends that shares the longest suffix with the pattern.

    An as-of search: the reversed pattern is put among the text's reversed prefixes; the
    longest common prefix is with the one just before or just after it. pos is 0-based and
    the smallest of the nearest; -1 where nothing matches.
    """
    n = F.length(text)
    ends = pairs.where(n > 0).select(F.col(key).alias("k"), F.col(text).alias("t"), F.explode(F.sequence(F.lit(1), n)).alias("end")).select("k", F.reverse(F.substring("t", F.lit(1), F.col("end"))).alias("rev"), (F.col("end") - 1).alias("pos"))
    asked = pairs.select(F.col(key).alias("k"), F.reverse(pattern).alias("rev"), F.lit(None).cast("int").alias("pos"))
    both = asked.unionByName(ends)
    w = Window.partitionBy("k").orderBy("rev", F.col("pos").isNotNull())
    entry = F.when(F.col("pos").isNotNull(), F.struct("rev", "pos"))
    near = both.withColumn("low", F.last(entry, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("high", F.first(entry, True).over(w.rowsBetween(1, Window.unboundedFollowing))).where(F.col("pos").isNull())
    from ..functions.strings import common_prefix

    low, high = (F.coalesce(common_prefix(F.col("rev"), F.col(f"{x}.rev")), F.lit(0)) for x in ("low", "high"))
    out = near.select("k", "low", "high", low.alias("a"), high.alias("b"))
    pos = F.when(F.greatest("a", "b") == 0, -1).when(F.col("a") >= F.col("b"), F.col("low.pos")).otherwise(F.col("high.pos"))
    return out.select(F.col("k").alias(key), pos.alias("pos"), F.greatest("a", "b").alias("matched"))


def longest_prefix_in(patterns: DataFrame, matches: DataFrame, pattern_id: str = "pattern_id", seq: str = "seq") -> DataFrame:
    """(pattern_id, text_id, pos, matched): where a prefix of some text ends that shares the longest suffix with the pattern.

    matches: the result of matching.mems_in; the match that reaches the pattern's end is the one. pos
    is -1 and text_id null where no text holds the last character.
    """
    own = patterns.where(F.col(seq).isNotNull()).select(F.col(pattern_id).alias("pattern_id"), F.length(seq).alias("n"))
    last = matches.where("len > 0").select("pattern_id", (F.col("start") + F.col("len")).alias("n"), "text_id", (F.col("text_pos") + F.col("len") - 1).alias("pos"), F.col("len").alias("matched"))
    return own.join(last, ["pattern_id", "n"], "left").select("pattern_id", "text_id", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("matched", F.lit(0)).alias("matched"))


def owners(places: DataFrame, starts: DataFrame, group: str, at: str, owner: str, start: str) -> DataFrame:
    """places with (owner, offset): an as-of join of positions to the last start at or before them, per group."""
    left = places.select(F.col(group).alias("g"), F.col(at).alias("at"), F.lit(None).cast("long").alias("owner"), F.lit(1).alias("kind"))
    right = starts.select(F.col(group).alias("g"), F.col(start).alias("at"), F.col(owner).cast("long").alias("owner"), F.lit(0).alias("kind"))
    w = Window.partitionBy("g").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = left.unionByName(right).withColumn("s", F.last(F.when(F.col("kind") == 0, F.struct("owner", "at")), True).over(w))
    return held.where("kind = 1").select(F.col("g").alias(group), F.col("at").alias(at), F.col("s.owner").alias(owner), (F.col("at") - F.col("s.at")).alias("offset"))


def with_prefix(keywords: DataFrame, word: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(prefix, keyword): keywords that start with each prefix.

    An equi-join on the keywords' prefixes of the lengths asked for; those lengths, no more
    than the longest prefix has characters, reach the tasks as a subquery's value.
    """
    asked = prefixes.select(F.col(prefix).alias("prefix")).where(F.col("prefix").isNotNull()).distinct()
    lengths = asked.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    own = keywords.select(F.col(word).alias("keyword")).withColumn("lengths", lengths.scalar())
    fits = F.filter("lengths", lambda n: n <= F.length("keyword"))
    cut = own.select("keyword", F.explode(fits).alias("n")).select("keyword", F.expr("left(keyword, n)").alias("prefix"))
    return cut.join(asked, "prefix").select("prefix", "keyword")
