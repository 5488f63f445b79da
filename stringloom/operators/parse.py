"""Text parses: LZ77, LZ-End and relative LZ phrases, their decoding, and prefix-free parsing.

A greedy parse depends on what came before, so it runs along each row's text as a fold; each
step finds its longest match by looking substrings up. Prefix-free parsing cuts at windows
whose rolling hash is 0 modulo p; phrases, their dictionary and the parse are joins.

Null texts give null phrases, empty texts none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import let
from .ranking import ranked
from .suffix import positions

PHRASE = "array<struct<dst:int,src:int,len:int,ch:string>>"


def _fold(text: Column, longest, source, first: Column) -> Column:
    """Phrases by a fold over the text; longest and source say how a step matches."""
    start = F.struct(first.cast("int").alias("i"), F.array().cast(PHRASE).alias("phrases"))

    def step(state: Column, _: Column, t: Column) -> Column:
        i = state["i"]

        def add(k: Column) -> Column:
            phrase = F.struct(i.alias("dst"), F.when(k > 0, source(t, i, k, state["phrases"])).otherwise(0).cast("int").alias("src"), k.cast("int").alias("len"), F.substring(t, i + k + 1, F.lit(1)).alias("ch"))
            return F.struct((i + k + 1).cast("int").alias("i"), F.concat(state["phrases"], F.array(phrase)).alias("phrases"))

        return F.when(i >= F.length(t), state).otherwise(let(longest(t, i, state["phrases"]), add))

    steps = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull(), let(text, lambda t: F.aggregate(steps, start, lambda s, x: step(s, x, t), lambda s: s["phrases"])))


def _monotone(most: Column, holds) -> Column:
    """The largest k up to most for which holds(k), where holds is monotone."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        return F.when(holds(middle), F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

    start = F.struct(F.lit(0).alias("low"), most.cast("int").alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(most + 2)).cast("int")), start, halve, lambda s: s["low"])


def _index_of(text: Column, part: Column) -> Column:
    return F.call_function("instr", text, part)


def lz77(text: Column) -> Column:
    """Phrases (dst, src, len, ch): a copy from earlier text, leftmost and not overlapping itself, and a literal.

    The literal of a last phrase that reaches the end is empty.
    """
    earlier = lambda t, i: F.substring(t, F.lit(1), i)
    return _fold(
        text,
        lambda t, i, _: _monotone(F.length(t) - i, lambda k: F.contains(earlier(t, i), F.substring(t, i + 1, k))),
        lambda t, i, k, _: _index_of(earlier(t, i), F.substring(t, i + 1, k)) - 1,
        F.lit(0),
    )


def lz_end(text: Column) -> Column:
    """As lz77, but a copy must end where an earlier phrase ends."""

    def ends(p: Column) -> Column:
        return F.transform(p, lambda x: x["dst"] + x["len"] + 1)

    def matches(t: Column, i: Column, k: Column, p: Column) -> Column:
        return F.filter(ends(p), lambda e: (e >= k) & (e <= i) & (F.substring(t, e - k + 1, k) == F.substring(t, i + 1, k)))

    def longest(t: Column, i: Column, p: Column) -> Column:
        sizes = F.sequence(F.lit(0), F.least(F.length(t) - i, i))
        return F.array_max(F.filter(sizes, lambda k: (k == 0) | (F.size(matches(t, i, k, p)) > 0)))

    return _fold(text, longest, lambda t, i, k, p: matches(t, i, k, p)[0] - k, F.lit(0))


def rlz(text: Column, reference_length: Column) -> Column:
    """Phrases against the text's own prefix of the given length, from its end on; src counts in the prefix."""
    reference = lambda t: F.substring(t, F.lit(1), reference_length)
    return _fold(
        text,
        lambda t, i, _: _monotone(F.least(F.length(t) - i, reference_length), lambda k: F.contains(reference(t), F.substring(t, i + 1, k))),
        lambda t, i, k, _: _index_of(reference(t), F.substring(t, i + 1, k)) - 1,
        F.least(reference_length, F.length(text)),
    )


def decode(phrases: Column) -> Column:
    """The text of lz77 or lz_end phrases."""
    return F.aggregate(phrases, F.lit(""), lambda out, x: F.concat(out, F.substring(out, x["src"] + 1, x["len"]), x["ch"]))


def decode_rlz(phrases: Column, reference: Column) -> Column:
    """The text of rlz phrases and their reference."""
    return F.aggregate(phrases, reference, lambda out, x: F.concat(out, F.substring(reference, x["src"] + 1, x["len"]), x["ch"]))


KR_PRIME, KR_BASE = 1_999_999_973, 256


def kr_hash(window: Column) -> Column:
    """Karp-Rabin hash of a window's code points."""
    return F.aggregate(F.filter(F.split(window, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * KR_BASE + F.ascii(c)) % KR_PRIME)


def pfp_phrases(texts: DataFrame, text_id: str, text: str, *, w: int = 10, p: int = 100) -> DataFrame:
    """(text_id, ord, phrase): the prefix-free parse of each text.

    Phrases overlap by w characters: each ends with a window whose hash is 0 modulo p, or
    with the text, and the next one starts with that window. Joined without the overlaps they
    are the text again.
    """
    cuts = positions(texts, text_id, text, w).where((F.length("key") == w) & (kr_hash(F.col("key")) % p == 0)).select("text_id", F.col("pos").alias("at"))
    whole = texts.where(F.length(text) > 0).select(F.col(text_id).alias("text_id"), F.col(text).alias("_text"))
    starts = cuts.unionByName(whole.select("text_id", F.lit(0).alias("at"))).distinct()
    order = Window.partitionBy("text_id").orderBy("at")
    ranges = starts.select("text_id", "at", (F.row_number().over(order) - 1).alias("ord"), F.lead("at").over(order).alias("next"))
    end = F.coalesce(F.col("next") + w, F.length("_text"))
    return ranges.join(whole, "text_id").select("text_id", "ord", F.substring("_text", F.col("at") + 1, end - F.col("at")).alias("phrase"))


def pfp_dictionary(phrases: DataFrame) -> DataFrame:
    """(phrase, occ, rank): distinct phrases with their counts, ranked from 1 in order."""
    return ranked(phrases.groupBy("phrase").agg(F.count("*").alias("occ")), ["phrase"], "rank")


def pfp_parse(phrases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text_id, ord, rank): each text as a sequence of dictionary ranks."""
    return phrases.join(dictionary.select("phrase", "rank"), "phrase").select("text_id", "ord", "rank")


def pfp_unparse(parse: DataFrame, dictionary: DataFrame, *, w: int = 10) -> DataFrame:
    """(text_id, text) from the parse and the dictionary."""
    spelled = parse.join(dictionary.select("phrase", "rank"), "rank").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("ord", "phrase"))).alias("ps"))
    return spelled.select("text_id", F.array_join(F.transform("ps", lambda x: F.when(x["ord"] == 0, x["phrase"]).otherwise(F.substring(x["phrase"], F.lit(w + 1), F.length(x["phrase"])))), "").alias("text"))
