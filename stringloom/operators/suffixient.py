"""Smallest suffixient sets: one end position per supermaximal right-extension.

Candidates are the two sides of every BWT run boundary of the reversed text, by character.
Candidates of one character in rank order are compared with their neighbours only: where
no smaller LCP lies between, the larger LCP stays; equal ones form a plateau of which the
first stays. A text that is sorted where its row is gives its set there, so that neither
suffixes nor candidates are shuffled or written; longer texts take the way by windows, where
the minimum between neighbours is taken over the text's LCP values in one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import common_prefix, let
from ..session import settle_rows
from . import sorting, suffix
from .suffix import reversed_texts

#: Names of construction algorithms that all give this set.
ALGORITHMS = ("one-pass", "linear", "fm", "PFP")


def suffixient_set(texts: DataFrame, text_id: str = "text_id", text: str = "text", *, algorithm: str = "one-pass") -> DataFrame:
    """(text_id, rank, ch, pos, lcp): end positions (0-based) of the set; the extension has lcp + 1 characters."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
    short, long = suffix.held(reversed_texts(texts, text_id, text))

    def work(s: sorting.Sorted) -> tuple[np.ndarray, list[pa.Array]]:
        row, rank, number, pos, lcp = chosen_in(s)
        return row, [pa.array(rank, pa.int32()), s.characters(number), pa.array(pos, pa.int32()), pa.array(lcp, pa.int32())]

    columns = [T.StructField(c, T.StringType() if c == "ch" else T.IntegerType()) for c in ("rank", "ch", "pos", "lcp")]
    out = suffix.by_text(short, suffix.WIDTH, columns, work)
    return out if long is None else out.unionByName(from_suffixes(settle_rows(suffix.joined(long, suffix.WIDTH), "suffixes")))


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each range, none of them empty; minima of doubled spans, one length held at a time."""
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    by = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[by], np.arange(level.max(initial=-1) + 2))
    table = values
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        own = by[a:b]
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
    return out


def chosen_in(s: sorting.Sorted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, character's number, pos, lcp) of the sets of sorted reversed texts, by text, character and rank."""
    lcps = s.lcp.astype(np.int32)
    bounds = np.flatnonzero((s.row[1:] == s.row[:-1]) & (s.bwt[1:] != s.bwt[:-1])) + 1
    at, side = np.concatenate([bounds, bounds]), np.concatenate([bounds - 1, bounds])
    kept = s.bwt[side] > 0
    at, side = at[kept], side[kept]
    order = np.lexsort((at, s.bwt[side], s.row[at]))
    at, side = at[order], side[order]
    row, number, lcp = s.row[at], s.bwt[side], lcps[at]
    linked = (row[1:] == row[:-1]) & (number[1:] == number[:-1])  # whether one and the next are of one character of a text
    gap = np.full(max(len(at) - 1, 0), 1 << 30, np.int32)
    far = np.flatnonzero(linked & (at[1:] > at[:-1] + 1))
    gap[far] = _least_between(lcps, at[far] + 1, at[far + 1])
    seen = linked & (gap >= np.minimum(lcp[1:], lcp[:-1]))  # they see each other at the height of the smaller one
    beaten = np.zeros(len(at), bool)
    beaten[1:] |= seen & (lcp[:-1] > lcp[1:])
    beaten[:-1] |= seen & (lcp[1:] > lcp[:-1])
    firsts = np.flatnonzero(np.concatenate([np.ones(min(len(at), 1), bool), ~(seen & (lcp[1:] == lcp[:-1]))]))
    best = firsts[~np.logical_or.reduceat(beaten, firsts)] if len(firsts) else firsts
    return row[best], s.rank[at[best]], number[best], s.lengths[row[best]] - s.sa[side[best]], lcp[best]


def from_suffixes(ordered: DataFrame) -> DataFrame:
    """The set from the suffixes (text_id, rank, sa, lcp, bwt) of the reversed texts."""
    w = Window.partitionBy("text_id").orderBy("rank")
    n = F.max("sa").over(Window.partitionBy("text_id"))
    bounds = ordered.select("text_id", "rank", "lcp", "sa", "bwt", n.alias("n"), F.lag("bwt").over(w).alias("bwt_before"), F.lag("sa").over(w).alias("sa_before")).where((F.col("rank") > 0) & ~F.col("bwt").eqNullSafe(F.col("bwt_before")))
    sides = F.explode(F.array(F.struct(F.col("bwt_before").alias("ch"), F.col("sa_before").alias("at")), F.struct(F.col("bwt").alias("ch"), F.col("sa").alias("at"))))
    candidates = bounds.select("text_id", "rank", "lcp", "n", sides.alias("c")).where(F.col("c.ch").isNotNull()).select("text_id", "rank", "lcp", "n", "c.ch", "c.at")
    own = Window.partitionBy("text_id", "ch").orderBy("rank")
    linked = settle_rows(candidates.withColumn("next", F.lead("rank").over(own)).withColumn("next_lcp", F.lead("lcp").over(own)), "candidates")
    gaps = linked.where(F.col("next") > F.col("rank") + 1).select("text_id", "ch", "rank", (F.col("rank") + 1).alias("low"), (F.col("next") - 1).alias("high"))
    # the gaps of one character don't overlap: a text's LCP values are read at most once for each of its characters
    heights = F.transform(F.array_sort(F.collect_list(F.struct("rank", "lcp"))), lambda x: x["lcp"])
    asked = gaps.groupBy("text_id").agg(F.collect_list(F.struct("ch", "rank", "low", "high")).alias("gaps"))
    met = asked.join(ordered.groupBy("text_id").agg(heights.alias("lcps")), "text_id")
    lowest = let(F.struct("gaps", "lcps"), lambda r: F.transform(r["gaps"], lambda g: F.struct(g["ch"].alias("ch"), g["rank"].alias("rank"), F.array_min(F.slice(r["lcps"], g["low"] + 1, g["high"] - g["low"] + 1)).alias("gap"))))
    between = met.select("text_id", F.inline(lowest))
    seq = linked.join(between, ["text_id", "ch", "rank"], "left").withColumn("gap", F.coalesce("gap", F.lit(1 << 30)))
    # the pair (this, next) sees each other at a height of the smaller LCP if the gap is no lower
    steps = seq.withColumn("before_lcp", F.lag("lcp").over(own)).withColumn("before_gap", F.lag("gap").over(own))
    same = (F.col("before_lcp") == F.col("lcp")) & (F.col("before_gap") >= F.col("lcp"))
    plateaus = steps.withColumn("plateau", F.sum(F.when(same, 0).otherwise(1)).over(own))
    beaten = ((F.col("before_lcp") > F.col("lcp")) & (F.col("before_gap") >= F.col("lcp"))) | ((F.col("next_lcp") > F.col("lcp")) & (F.col("gap") >= F.col("lcp")))
    kept = plateaus.groupBy("text_id", "ch", "plateau").agg(F.max(F.coalesce(beaten, F.lit(False))).alias("beaten"), F.min(F.struct("rank", "at", "lcp", "n")).alias("first")).where(~F.col("beaten"))
    return kept.select("text_id", F.col("first.rank").alias("rank"), "ch", (F.col("first.n") - F.col("first.at")).cast("int").alias("pos"), F.col("first.lcp").alias("lcp"))


def extensions(chosen: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(text_id, extension): the supermaximal right-extensions."""
    own = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("_text"))
    return chosen.join(own, "text_id").select("text_id", F.substring("_text", F.col("pos") - F.col("lcp") + 1, F.col("lcp") + 1).alias("extension"))


def index(chosen: DataFrame) -> DataFrame:
    """The set with its place in the order by character, then co-lexicographic (ord), and within its bucket (in_bucket)."""
    bucket = Window.partitionBy("text_id", "ch").orderBy("rank")
    all_of = Window.partitionBy("text_id").orderBy("ch", "rank")
    return chosen.withColumn("ord", F.row_number().over(all_of) - 1).withColumn("in_bucket", F.row_number().over(bucket) - 1)


def neighbours(chosen: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(text_id, ch, rank, pos, lcs, len): common suffix with the entry before in the bucket, and the larger of both neighbours'."""
    own = texts.select(F.col(text_id).alias("text_id"), F.reverse(F.col(text)).alias("_rev"), F.length(text).alias("_n"))
    bucket = Window.partitionBy("text_id", "ch").orderBy("rank")
    before = chosen.withColumn("_prev", F.lag("pos").over(bucket)).join(own, "text_id")
    tail = lambda c: F.substring("_rev", F.col("_n") - F.col(c), F.col(c) + 1)  # noqa: E731  the prefix up to pos, reversed
    shared = common_prefix(tail("pos"), tail("_prev"))
    lcs = before.select("text_id", "ch", "rank", "pos", F.coalesce(shared, F.lit(0)).alias("lcs"))
    return lcs.withColumn("len", F.greatest("lcs", F.coalesce(F.lead("lcs").over(bucket), F.lit(0))))


def multiplicities(chosen: DataFrame) -> DataFrame:
    """(text_id, ch, n, first): entries per last character and the bucket's first place."""
    counts = chosen.groupBy("text_id", "ch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("text_id").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("first", F.coalesce(before, F.lit(0)))


def measures(chosen: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(text_id, n, chi): text length and size of the set."""
    sizes = texts.where(F.length(text) > 0).select(F.col(text_id).alias("text_id"), F.length(text).alias("n"))
    return sizes.join(chosen.groupBy("text_id").agg(F.count("*").alias("chi")), "text_id")


def kmer_contexts(chosen: DataFrame, texts: DataFrame, k: int = 10, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(text_id, distinct_kmers, max_frequency): k-mers that end at positions of the set; positions before k - 1 are left out."""
    own = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("_text"))
    kmers = chosen.where(F.col("pos") + 1 >= k).join(own, "text_id").select("text_id", F.substring("_text", F.col("pos") - k + 2, F.lit(k)).alias("kmer"))
    return kmers.groupBy("text_id", "kmer").agg(F.count("*").alias("c")).groupBy("text_id").agg(F.count("*").alias("distinct_kmers"), F.max("c").alias("max_frequency"))
