"""Scalar string operators as Column expressions: extraction, common prefixes and suffixes, DNA codes.

Positions are 0-based and count characters. Everything is null where an argument is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind a value once for use inside lambdas, where Catalyst might otherwise repeat it per element."""
    return F.transform(F.array(value), body)[0]


def as_bytes(text: Column) -> Column:
    """One character per byte, ordered like the bytes, for byte semantics of the operators."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def extract(text: Column, i: Column) -> Column:
    """The character at i; empty outside the text."""
    return F.when((i >= 0) & (i < F.length(text)), F.substring(text, i + 1, F.lit(1))).otherwise(F.when(text.isNotNull() & i.isNotNull(), F.lit("")))


def display(text: Column, start: Column, end: Column) -> Column:
    """Characters start to end, both included, cut at the text's end; null if start > end."""
    return F.when((start <= end) & (start >= 0), F.substring(text, start + 1, end - start + 1))


def _match(a: Column, b: Column) -> Column:
    """Length of the common prefix: a binary search, as equality of prefixes is monotone."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(state["low"]).alias("low"), F.when(same, state["high"]).otherwise(middle - 1).alias("high"))

    most = F.least(F.length(a), F.length(b))
    start = F.struct(F.lit(0).alias("low"), most.alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 2)).cast("int"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(steps, start, halve, lambda s: s["low"]))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: _match(s["a"], s["b"]))


def lcp(pattern: Column, p: Column, text: Column, t: Column) -> Column:
    """How far pattern from p and text from t agree, forwards."""
    return common_prefix(F.substring(pattern, p + 1, F.length(pattern)), F.substring(text, t + 1, F.length(text)))


def lcs(pattern: Column, p: Column, text: Column, t: Column) -> Column:
    """How far pattern up to p and text up to t, both included, agree, backwards."""
    return common_prefix(F.reverse(F.substring(pattern, F.lit(1), p + 1)), F.reverse(F.substring(text, F.lit(1), t + 1)))


def lcs_char(pattern: Column, p: Column, text: Column, t: Column) -> Column:
    """(lcs, char): with the text's character that ends the match, null where a start was reached."""
    n = lcs(pattern, p, text, t)
    return let(n, lambda k: F.struct(k.alias("lcs"), F.when((k <= p) & (k <= t), F.substring(text, t - k + 1, F.lit(1))).alias("char")))


DNA_BLOCK = 31


def is_dna(text: Column) -> Column:
    """Whether the text is A, C, G, T only, in either case; true for the empty text."""
    return text.rlike("^[ACGTacgt]*$")


def dna_pack(text: Column) -> Column:
    """Two bits per character, DNA_BLOCK characters per number, the last block shorter; null unless DNA."""
    codes = F.translate(text, "ACGTacgt", "01230123")
    blocks = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / DNA_BLOCK).cast("int")), lambda i: F.substring(codes, i * DNA_BLOCK + 1, F.lit(DNA_BLOCK)))).otherwise(F.array().cast("array<string>"))
    return F.when(is_dna(text), F.transform(blocks, lambda b: F.conv(b, 4, 10).cast("long")))


def dna_unpack(blocks: Column, length: Column) -> Column:
    """The upper-case text of packed blocks."""
    last = F.size(blocks) - 1

    def spell(b: Column, i: Column) -> Column:
        return F.translate(F.lpad(F.conv(b.cast("string"), 10, 4), F.when(i < last, F.lit(DNA_BLOCK)).otherwise((length - last * DNA_BLOCK).cast("int")), F.lit("0")), "0123", "ACGT")

    return F.array_join(F.transform(blocks, spell), "")


def occurrences(text: Column, pattern: Column) -> Column:
    """All start positions, overlapping ones too; none for the empty pattern. For short texts."""
    starts = F.sequence(F.lit(0), F.length(text) - F.length(pattern))
    return F.when((F.length(pattern) > 0) & F.contains(text, pattern), F.filter(starts, lambda i: F.substring(text, i + 1, F.length(pattern)) == pattern)).when(text.isNotNull() & pattern.isNotNull(), F.array().cast("array<int>"))
