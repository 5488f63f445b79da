"""All occurrences of patterns in a collection, found over its phrases.

An occurrence that holds a phrase's literal is *primary*; any other lies inside what one
phrase copied, and is the copy of an earlier occurrence.

Primary: a pattern is split at every character, which may be the first literal that an
occurrence holds. What comes up to the literal, read backwards, and what follows it are
prefixes of the two keys of a phrase's border, so that a split is a box in the plane of both
sort orders and its occurrences are the borders inside. Borders of equal keys are one point of
the plane, as repetitive texts have many of them; they are told apart at the end. Both orders
are made over range partitions, and boxes meet points by cells of their narrower side. Keys hold
KEY characters; what reaches further is compared piece by piece with runs of the text, never
with whole texts.

Secondary: an occurrence asks for the sources that hold it. Sources are filed by the power
of two of their length, under cells of that size, which are three at most; an occurrence asks
one cell of each size from its own length on. A step copies all new occurrences at once, and
no occurrence comes twice, as it lies in one copy. There are as many steps as copies of copies.

Patterns that fit into a task are looked for where a text is parsed (`locate_in_rows`), in the same
two ways: primary ones among the starts up to the next literal, by the first characters of all
positions, and copies from the phrases whose source holds them. Then no phrase leaves its task.

Null and empty patterns and texts give no occurrences; positions are 0-based characters.
pattern_id and text_id are keys; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forget, settle, small_bytes, spread
from . import phrases as parsing
from . import sorting
from .corpus import global_ranks
from .fm import points_in
from .suffix import RUN, text_runs

KEY = 32

#: Rows of keys inside boxes that are sent to the tasks; more are joined by a shuffle.
SENT = 100_000

#: Characters of all patterns that are sent to the tasks that parse the texts.
HELD = 1 << 20

#: Borders of one key that meet in a task of that shuffle, about.
HOT = 1_000_000


def _run_of(place: Column) -> Column:
    return (F.floor(place / RUN) * RUN).cast("int")


def borders(phrases: DataFrame, runs: DataFrame, *, key: int = KEY) -> DataFrame:
    """(text_id, dst, at, back, ahead): where each phrase's literal is, the phrase up to it read backwards, and what follows, of `key` characters at most."""
    ends = phrases.where(F.length("ch") > 0).select("text_id", "dst", (F.col("dst") + F.col("len")).alias("at"))
    begun = ends.withColumn("start", F.greatest(F.col("dst"), F.col("at") - (key - 1)))
    met = begun.withColumn("base", _run_of(F.col("start"))).join(runs, ["text_id", "base"])
    offset, size = F.col("start") - F.col("base"), F.col("at") - F.col("start") + 1
    return met.select("text_id", "dst", "at", F.reverse(F.substring("run", offset + 1, size)).alias("back"), F.substring("run", offset + size + 1, F.lit(key)).alias("ahead"))


def _order(keys: DataFrame, asked: DataFrame, column: str, tie: str, place: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct keys (column, tie) with their place in the order of the column, (column, low, high): between which places those with a prefix are, and the table of both."""
    spelled = F.col(column).cast("binary")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("kind"), spelled.alias("key")), F.struct(F.lit(2).alias("kind"), F.concat(spelled, F.lit(b"\xff")).alias("key"))))
    bounds = asked.select(column).distinct().select(column, ends.alias("e")).select("e.key", "e.kind", column, F.lit(None).cast(keys.schema[tie].dataType).alias(tie))
    own = keys.select(spelled.alias("key"), F.lit(1).alias("kind"), column, tie)
    rows = settle(own.unionByName(bounds), "keys")
    by = ["key", "kind", tie]
    places = global_ranks(rows, by, {place: by}, ["kind", column, tie])
    forget(rows)
    ranges = places.where("kind != 1").groupBy(column).agg(F.min(place).alias(f"low_{place}"), F.max(place).alias(f"high_{place}"))
    return places.where("kind = 1").select(column, tie, place), ranges, places


def _expanded(points: DataFrame, keys: DataFrame, met: DataFrame) -> DataFrame:
    """The points (back, ahead, ...) with the settled rows met of their keys (back, ahead, n), of which n points are; a frequent key's points go to several tasks."""
    both = ["back", "ahead"]
    if met.count() <= SENT:
        return points.join(F.broadcast(met), both)
    hot = F.broadcast(keys.where(F.col("n") > HOT).select(*both, F.ceil(F.col("n") / HOT).alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    dealt = points.join(hot, both, "left").withColumn("share", F.pmod(F.xxhash64("text_id", "at"), shares)).drop("shares")
    copied = met.join(hot, both, "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares")
    return dealt.join(copied.hint("merge"), [*both, "share"]).drop("share")


def _agreeing(candidates: DataFrame, patterns: DataFrame, runs: DataFrame, key: int) -> DataFrame:
    """The candidates (pattern_id, text_id, pos, len) whose whole pattern stands there, compared in pieces."""
    piece = 2 * key
    cut = candidates.join(patterns, "pattern_id").withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - 1, F.lit(piece))))
    cut = cut.select("pattern_id", "text_id", "pos", "len", (F.col("pos") + F.col("off")).alias("at"), F.substring("seq", F.col("off") + 1, F.lit(piece)).alias("piece"))
    met = cut.withColumn("base", _run_of(F.col("at"))).join(runs, ["text_id", "base"])
    same = met.where(F.substring("run", F.col("at") - F.col("base") + 1, F.length("piece")) == F.col("piece"))
    counted = same.groupBy("pattern_id", "text_id", "pos", "len").agg(F.count("*").alias("c"))
    return counted.where(F.col("c") == F.ceil(F.col("len") / piece)).drop("c")


def primary(patterns: DataFrame, phrases: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text", *, key: int = KEY) -> DataFrame:
    """(pattern_id, text_id, pos, len): the occurrences of patterns (pattern_id, seq) that hold a phrase's literal."""
    runs = settle(text_runs(texts, text_id, text, 2 * key).select("text_id", "base", "run"), "runs")
    points = settle(borders(phrases, runs, key=key), "borders")
    asked = patterns.where(F.length("seq") > 0).select("pattern_id", "seq")
    k, size = F.col("k"), F.length("seq")
    every = asked.withColumn("k", F.explode(F.sequence(F.lit(1), size)))
    back = F.reverse(F.substring("seq", F.greatest(k - key, F.lit(0)) + 1, F.least(k, F.lit(key))))
    splits = settle(every.select("pattern_id", size.alias("len"), "k", back.alias("back"), F.substring("seq", k + 1, F.lit(key)).alias("ahead")), "splits")
    keys = settle(points.groupBy("back", "ahead").agg(F.count("*").alias("n")), "border-keys")
    xs, across, x_places = _order(keys, splits, "back", "ahead", "x")
    ys, along, y_places = _order(xs, splits, "ahead", "x", "y")
    boxes = splits.join(across, "back").join(along, "ahead")
    boxes = boxes.select(F.struct("pattern_id", "len", "k").alias("box_id"), F.col("low_x").alias("x0"), F.col("high_x").alias("x1"), F.col("low_y").alias("y0"), F.col("high_y").alias("y1"))
    inside = settle(points_in(ys.select("x", "y"), boxes).join(xs, "x").select("box_id.*", "back", "ahead"), "inside")
    forget(x_places, y_places)
    met = _expanded(points, keys, inside)
    met = met.where(k <= F.col("at") - F.col("dst") + 1)  # else an earlier literal is the first
    found = settle(met.select("pattern_id", "text_id", (F.col("at") - k + 1).alias("pos"), "len", ((k > key) | (F.col("len") - k > key)).alias("open")), "primary")
    forget(points, keys, splits, inside)
    return found.where("not open").drop("open").unionByName(_agreeing(found.where("open").drop("open"), asked, runs, key))


def secondary(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """(pattern_id, text_id, pos, len, copies): settled occurrences (of 0 copies) and what phrases copied of them, of copies, and so on."""
    level = F.length(F.bin("len")) - 1
    copied = phrases.where("len > 0").select("text_id", "src", F.col("len").alias("held"), "dst", level.alias("level"))
    cells = F.expr("explode(sequence(src div shiftleft(1, level), (src + held - 1) div shiftleft(1, level)))")
    sources = settle(copied.select("*", cells.alias("cell")), "sources")
    most = sources.agg(F.max("level")).first()[0]
    state = found.select("pattern_id", "text_id", "pos", "len", F.lit(0).alias("copies"))
    out = state
    while most is not None and state.limit(1).count():
        own = state.where(level <= most).withColumn("level", F.explode(F.sequence(level, F.lit(most))))
        met = own.withColumn("cell", F.expr("pos div shiftleft(1, level)")).join(sources, ["text_id", "level", "cell"])
        inside = (F.col("src") <= F.col("pos")) & (F.col("pos") + F.col("len") <= F.col("src") + F.col("held"))
        state = settle(met.where(inside).select("pattern_id", "text_id", (F.col("dst") + F.col("pos") - F.col("src")).alias("pos"), "len", (F.col("copies") + 1).alias("copies")), "copies")
        out = out.unionByName(state)
    return out


def locate_all(patterns: DataFrame, phrases: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text", *, key: int = KEY) -> DataFrame:
    """(pattern_id, text_id, pos, len, copies): every occurrence in the texts, whose phrases by any parse of this package are given, settled or not."""
    parsed = settle(phrases, "parsed")
    return secondary(settle(primary(patterns, parsed, texts, text_id, text, key=key), "found"), parsed)


def _starts(texts: list[str], first: np.ndarray, literals: np.ndarray, patterns: list[str], by_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern's number, place) of the occurrences that hold a literal; places count through all texts, of which each begins at `first`."""
    h = sorting.heads(texts, parsing.HEAD)
    until = np.append(literals, np.iinfo(np.int64).max)[np.searchsorted(literals, np.arange(first[-1]))]
    number = {c: i + 1 for i, c in enumerate(h.alphabet.tolist())}
    packed = h.packed & ((1 << (h.bits * h.size)) - 1)
    out = []
    for n, same in groupby(by_length, lambda i: len(patterns[i])):
        head = min(n, h.size)
        known = [(code, i) for i in same if None not in (letters := [number.get(ord(c)) for c in patterns[i]]) for code in (sum(x << (h.bits * (head - 1 - k)) for k, x in enumerate(letters[:head])),)]
        if not known:
            continue
        codes, ids = (np.array(c, np.int64) for c in zip(*sorted(known)))
        at = np.flatnonzero(until < np.arange(first[-1]) + n)
        keys = packed[at] >> (h.bits * (h.size - head))
        low = np.searchsorted(codes, keys)
        hit = codes[np.minimum(low, len(codes) - 1)] == keys
        at, keys, low = at[hit], keys[hit], low[hit]
        found = np.searchsorted(codes, keys, "right") - low
        which, at = ids[np.repeat(low - np.cumsum(found) + found, found) + np.arange(found.sum())], np.repeat(at, found)
        if n > head:
            row = h.row[at]
            whole = [texts[r].startswith(patterns[i], p) for r, i, p in zip(row.tolist(), which.tolist(), h.at[at].tolist())]
            which, at = which[whole], at[whole]
        out.append((which, at))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _copies(at: np.ndarray, sizes: np.ndarray, src: np.ndarray, dst: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the occurrence, place) of what phrases copied of occurrences that lie in their sources."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        own = own[np.argsort(at[own], kind="stable")]
        long = np.flatnonzero(held >= n)
        low = np.searchsorted(at[own], src[long])
        found = np.searchsorted(at[own], src[long] + held[long] - n, "right") - low
        which = own[np.repeat(low - np.cumsum(found) + found, found) + np.arange(found.sum())]
        out.append((which, at[which] + np.repeat((dst - src)[long], found)))
    return tuple(np.concatenate(c) for c in zip(*out))


def locate_in_rows(patterns: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """`locate_all` by the LZ77 phrases of the texts, made and searched where a text's row is; patterns beyond HELD characters go by tables of phrases."""
    asked = patterns.where(F.length("seq") > 0).select("pattern_id", "seq")
    if (asked.agg(F.sum(F.length("seq"))).first()[0] or 0) > HELD:
        return locate_all(patterns, parsing.lz77(texts, text_id, text), texts, text_id, text)
    small_bytes(texts.sparkSession)
    sent = asked.toArrow().combine_chunks()
    seqs, ids = sent["seq"].to_pylist(), pa.array(sent["pattern_id"].to_pylist(), sent["pattern_id"].type)
    lengths = np.array([len(s) for s in seqs], np.int64)
    by_length = np.argsort(lengths, kind="stable").tolist()

    def located(some: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text's number, pattern's number, place in the text, copies)."""
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])])
        triples, counts = [], []
        for found in parsing.parses(some):
            counts.append(len(found))
            triples += found
        dst, src, held = np.array(triples, np.int64).reshape(-1, 3).T
        base = np.repeat(first[:-1], counts)
        dst, src, ends = dst + base, src + base, np.repeat(first[1:] - 1, counts)
        literals = (dst + held)[dst + held < ends]
        which, at = _starts(some, first, literals, seqs, by_length)
        dst, src, held, copies = dst[held > 0], src[held > 0], held[held > 0], 0
        while len(at):
            row = np.searchsorted(first, at, "right") - 1
            yield row, which, at - first[row], np.full(len(at), copies)
            old, at = _copies(at, lengths[which], src, dst, held)
            which, copies = which[old], copies + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, some in sorting.chunks(batch.column(1).to_pylist()):
                for row, which, at, copies in located(some):
                    numbers = (pa.array(c, pa.int32()) for c in (at, lengths[which], copies))
                    table = pa.table([ids.take(pa.array(which)), batch.column(0).take(pa.array(row + begin)), *numbers], ["pattern_id", "text_id", "pos", "len", "copies"])
                    yield from table.to_batches(max_chunksize=parsing.ROWS)

    own = texts.where((F.length(text) > 0) & F.col(text_id).isNotNull()).select(F.col(text_id).alias("text_id"), F.col(text).alias("text"))
    numbers = [T.StructField(n, T.IntegerType()) for n in ("pos", "len", "copies")]
    schema = T.StructType([asked.schema["pattern_id"], own.schema["text_id"], *numbers])
    return spread(own, "text_id").mapInArrow(work, schema)
