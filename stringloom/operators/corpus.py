"""Suffix order of a whole collection over range partitions: no window holds a text, no task a common key.

The collection's suffixes are sorted together, by characters and, where whole suffixes are
equal, by text. Rows are dealt out by ranges of what they are sorted by, with text and
position as a tie-break, so that rows of one key may lie in several partitions. A rank is the
place inside the partition plus the sizes of the partitions before; where a key began in an
earlier partition, its rank is carried over the border. Only a row per partition is ever
brought together.

Sorting starts from each position's next WIDTH characters and doubles what is compared by
looking up the rank that far ahead in the same text. Only positions whose rank is shared and
whose text goes on take part in the next round.

Null and empty texts give no rows. text_id is a key and is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import common_prefix
from ..session import forget, settle_rows
from . import ranges
from .suffix import WIDTH, positions

#: Rows of a range partition, about.
ROWS = 2_000_000


def _changed(columns: list[pa.Array], before: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it, nulls being alike; `before` is the row before the first, if any."""
    out = np.zeros(len(columns[0]), bool)
    for column, last in zip(columns, before or [c.slice(0, 0) for c in columns], strict=True):
        whole = pa.concat_arrays([last, column])
        a, b = whole.slice(1), whole.slice(0, len(whole) - 1)
        out[len(column) - len(a) :] |= pc.coalesce(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    if not before:
        out[:1] = True
    return out


def _ranked(df: DataFrame, order: list[str], names: dict[str, list[str]]) -> DataFrame:
    """The rows in range partitions of `order`, sorted, with the partition's number in _part and, for every name, the place in it of the first row of the row's key."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(df.count() / ROWS))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, starts, before = 0, dict.fromkeys(names, 0), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            place = seen + np.arange(batch.num_rows)
            for n, by in names.items():
                columns = [batch.column(c) for c in by]
                ranks = np.maximum.accumulate(np.where(_changed(columns, before.get(n, [])), place, starts[n]))
                before[n], starts[n] = [c.slice(len(c) - 1) for c in columns], int(ranks[-1])
                batch = batch.append_column(f"_{n}", pa.array(ranks, pa.int64()))
            seen += batch.num_rows
            yield batch

    return dealt.mapInArrow(work, T.StructType([*dealt.schema.fields, *(T.StructField(f"_{n}", T.LongType()) for n in names)]))


def global_ranks(df: DataFrame, order: list[str], names: dict[str, list[str]], kept: list[str]) -> DataFrame:
    """The kept columns of a settled table, settled, with, for every name, how many rows come before the row's key; the keys are prefixes of `order`.

    order must tell all rows apart, or what it leaves tied must not matter.
    """
    keys = {n: F.struct(*by) for n, by in names.items()}
    ranked = settle_rows(_ranked(df, order, names), "ranks")
    ends = [F.min(k).alias(f"first_{n}") for n, k in keys.items()] + [F.max(k).alias(f"last_{n}") for n, k in keys.items()] + [F.max(f"_{n}").alias(f"start_{n}") for n in names]
    parts = ranked.groupBy("_part").agg(F.count("*").alias("_n"), *ends)  # a row per partition
    along = Window.orderBy("_part")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for n in names:
        joined = F.coalesce(F.lag(f"last_{n}").over(along) == F.col(f"first_{n}"), F.lit(False))
        parts = parts.withColumn(f"joined_{n}", joined)
        # where the partition's last key began, if it began here
        began = F.when(~F.col(f"joined_{n}") | (F.col(f"first_{n}") != F.col(f"last_{n}")), F.col("_before") + F.col(f"start_{n}"))
        parts = parts.withColumn(f"_began_{n}", began).withColumn(f"carried_{n}", F.last(f"_began_{n}", True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    borders = parts.select("_part", "_before", *(f"{x}_{n}" for n in names for x in ("joined", "carried")))
    met = ranked.join(F.broadcast(borders), "_part")
    final = {n: F.when(F.col(f"joined_{n}") & (F.col(f"_{n}") == 0), F.col(f"carried_{n}")).otherwise(F.col("_before") + F.col(f"_{n}")) for n in names}
    out = settle_rows(met.withColumns(final).select(*kept, *names), "ranked")
    forget(ranked)
    return out


def previous(df: DataFrame, rank: str, value: Column, name: str) -> DataFrame:
    """The rows with the value of the row before, in the order of `rank`, which counts them all from 0; null at the first.

    Runs of ranks are windows of their own, to which the row before the first is added.
    """
    size = min(ROWS, 1 << 16)
    run, ahead = F.floor(F.col(rank) / size), F.floor((F.col(rank) + 1) / size)
    each = df.withColumn("_value", value).withColumn("_run", F.explode(F.array_distinct(F.array(run, ahead))))
    lagged = each.withColumn("_lag", F.lag("_value").over(Window.partitionBy("_run").orderBy(rank)))
    return lagged.where(F.col("_run") == run).select(*df.columns, F.col("_lag").alias(name))


def _levels(texts: DataFrame, text_id: str, text: str, width: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(text_id, pos, left, key, before) of all positions, and the ranks (text_id, pos, r) by the next so many characters."""
    size_of = texts.where(F.length(text) > 0).select(F.col(text_id).alias("text_id"), F.length(text).alias("n"))
    chars = positions(texts, text_id, text, width).join(size_of, "text_id").where(F.col("pos") < F.col("n"))
    chars = settle_rows(chars.select("text_id", "pos", (F.col("n") - F.col("pos")).alias("left"), "key", "before"), "positions")
    ranks = global_ranks(chars.select("text_id", "pos", "left", "key"), ["key", "text_id", "pos"], {"r": ["key"]}, ["text_id", "pos", "left"])
    levels, size = [(width, ranks)], width
    while True:
        # ranks that several positions share, of which one goes on beyond what was compared
        shared = ranks.groupBy("r").agg(F.count("*").alias("c"), F.max("left").alias("most")).where((F.col("c") > 1) & (F.col("most") > size)).select("r")
        active = ranks.join(shared, "r", "left_semi")
        ahead = ranks.select("text_id", (F.col("pos") - size).alias("pos"), F.col("r").alias("s"))
        asked = settle_rows(active.join(ahead, ["text_id", "pos"], "left").select("text_id", "pos", "left", "r", F.coalesce("s", F.lit(-1)).alias("s")), "active")
        if not asked.limit(1).count():
            return chars, levels
        placed = global_ranks(asked, ["r", "s", "text_id", "pos"], {"x": ["r", "s"], "y": ["r"]}, ["text_id", "pos", "r"])
        moved = placed.select("text_id", "pos", (F.col("r") + F.col("x") - F.col("y")).alias("new"))
        ranks = settle_rows(ranks.join(moved, ["text_id", "pos"], "left").select("text_id", "pos", "left", F.coalesce("new", "r").alias("r")), "level")
        forget(asked, placed)
        size *= 2
        levels.append((size, ranks))


def suffix_order(texts: DataFrame, text_id: str = "text_id", text: str = "text", *, width: int = WIDTH) -> DataFrame:
    """(rank, text_id, pos): all suffixes of all texts in order from 0, equal ones by text."""
    _, levels = _levels(texts, text_id, text, width)
    last = levels[-1][1].select("text_id", "pos", "r")
    return global_ranks(last, ["r", "text_id", "pos"], {"rank": ["r", "text_id", "pos"]}, ["text_id", "pos"]).select("rank", "text_id", "pos")


def suffixes(texts: DataFrame, text_id: str = "text_id", text: str = "text", *, width: int = WIDTH) -> DataFrame:
    """(rank, text_id, pos, lcp, bwt): with the common prefix with the suffix before, and the character before the suffix, null at a text's start."""
    told = ranges.suffixes(texts, max(1, ROWS // 4), text_id, text, width)
    return _by_levels(texts, text_id, text, width) if told is None else told


def _by_levels(texts: DataFrame, text_id: str, text: str, width: int) -> DataFrame:
    """`suffixes` by ranks of all positions at every length, which no frequent key or long repeat makes larger."""
    chars, levels = _levels(texts, text_id, text, width)
    last = levels[-1][1].select("text_id", "pos", "left", "r")
    order = global_ranks(last, ["r", "text_id", "pos"], {"rank": ["r", "text_id", "pos"]}, ["text_id", "pos", "left"])
    pairs = previous(order, "rank", F.struct("text_id", "pos", "left"), "prev")
    pairs = pairs.select("rank", "text_id", "pos", "left", F.col("prev.text_id").alias("p_text"), F.col("prev.pos").alias("p_pos"), F.least("left", "prev.left").alias("most"), F.lit(0).alias("done"))
    held = order
    for size, ranks in reversed(levels):
        for t, p, name in (("text_id", "pos", "r_own"), ("p_text", "p_pos", "r_prev")):
            own = ranks.select(F.col("text_id").alias("_t"), F.col("pos").alias("_p"), F.col("r").alias(name))
            pairs = pairs.join(own, (F.col(t) == F.col("_t")) & (F.col(p) + F.col("done") == F.col("_p")), "left").drop("_t", "_p")
        pairs = pairs.withColumn("done", F.col("done") + F.when(F.col("r_own") == F.col("r_prev"), size).otherwise(0)).drop("r_own", "r_prev")
        pairs = settle_rows(pairs, "pairs")  # the shuffles of one level at a time
        forget(held, ranks)
        held = pairs
    for t, p, name in (("text_id", "pos", "k_own"), ("p_text", "p_pos", "k_prev")):
        own = chars.select(F.col("text_id").alias("_t"), F.col("pos").alias("_p"), F.col("key").alias(name))
        pairs = pairs.join(own, (F.col(t) == F.col("_t")) & (F.col(p) + F.col("done") == F.col("_p")), "left").drop("_t", "_p")
    rest = F.coalesce(common_prefix(F.col("k_own"), F.col("k_prev")), F.lit(0))
    lcps = pairs.select("rank", "text_id", "pos", F.coalesce(F.least(F.col("done") + rest, F.col("most")), F.lit(0)).alias("lcp"))
    return lcps.join(chars.select("text_id", "pos", "before"), ["text_id", "pos"]).select("rank", "text_id", "pos", "lcp", F.when(F.col("pos") > 0, F.col("before")).alias("bwt"))


def runs(ordered: DataFrame) -> DataFrame:
    """(ch, runs, length): how many runs of each character the collection's BWT has, and its rows; ch is null for text starts.

    Rows of one batch whose ranks follow each other are a stretch, counted where it is; stretches meet by their ends.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, letters = batch.column(0).to_numpy(), batch.column(1).dictionary_encode()
            order = np.argsort(rank, kind="stable")
            rank, codes = rank[order], pc.fill_null(letters.indices, -1).to_numpy(zero_copy_only=False)[order]
            begins = np.concatenate([[True], rank[1:] != rank[:-1] + 1])
            new = begins.copy()
            new[1:] |= codes[1:] != codes[:-1]
            kinds, number = np.unique(codes, return_inverse=True)
            spelled = letters.dictionary.take(pa.array(kinds, pa.int32(), mask=kinds < 0))
            counts = [np.bincount(number, new, len(kinds)).astype(np.int64), np.bincount(number, minlength=len(kinds))]
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(rank)) - 1
            none = pa.nulls(len(kinds), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, spelled, pa.nulls(len(kinds), pa.string()), *map(pa.array, counts)], names)
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rank[first]), pa.array(rank[last]), spelled.take(pa.array(number[first])), spelled.take(pa.array(number[last])), none, none], names)

    names = ["first", "last", "ch", "end", "runs", "length"]
    found = settle_rows(ordered.select("rank", "bwt").mapInArrow(work, "first long, last long, ch string, end string, runs long, length long"), "stretches")
    stretches = found.where("first is not null")
    ahead = stretches.select((F.col("last") + 1).alias("first"), "end")
    joined = stretches.select("first", "ch").join(ahead.hint("merge"), "first").where(F.col("ch").eqNullSafe(F.col("end")))
    less = joined.select("ch", F.lit(-1).cast("long").alias("runs"), F.lit(0).cast("long").alias("length"))
    return found.where("first is null").select("ch", "runs", "length").unionByName(less).groupBy("ch").agg(F.sum("runs").alias("runs"), F.sum("length").alias("length"))
