"""Suffix sorting text by text: ranks by prefix doubling, LCP by binary lifting, BWT and runs.

A text is a row and is sorted where its row is (`sorting.py`), so that nothing but the texts
is shuffled, once, to deal them out evenly. Texts of more than LONG characters, which would
fill a task's memory, are sorted by joins and windows: a window over text_id holds at most
one text. A position starts with a
key of its next WIDTH characters; ranks of keys are doubled by looking up the rank that many
characters on, until every rank of every text is unique. The ranks of all levels are kept:
from the longest to the shortest, equal ranks advance both positions by the level's length,
which gives the common prefix of neighbours in a logarithmic number of joins.

Orders are those of UTF-8 strings (code points). The empty suffix, which stands for the
terminator, is rank 0. Null and empty texts give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import common_prefix
from ..session import settle_rows, spread
from . import sorting

WIDTH = 32

#: Characters of a text that is sorted in a task's memory, at some 200 bytes each.
LONG = 1 << 22

#: Rows of an Arrow batch.
ROWS = 100_000

#: Positions are cut out of runs of so many characters, as string functions count from a string's start.
RUN = 256


def text_runs(texts: DataFrame, text_id: str, text: str, width: int) -> DataFrame:
    """(text_id, n, base, run, edge): RUN positions' characters from `base` on, with `width` more, and the one before."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.floor(n / RUN).cast("int"))
    runs = F.transform(starts, lambda i: F.struct(F.substring(text, i * RUN + 1, F.lit(RUN + width)).alias("run"), F.when(i > 0, F.substring(text, i * RUN, F.lit(1))).otherwise("").alias("edge")))
    return texts.where(n > 0).select(F.col(text_id).alias("text_id"), n.alias("n"), F.posexplode(runs)).select("text_id", "n", (F.col("pos") * RUN).alias("base"), "col.run", "col.edge")


def positions(texts: DataFrame, text_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """(text_id, pos, key, before): every position with its next `width` characters and the one before it.

    Includes the end of the text, whose key is empty. `before` is empty at position 0.
    """
    inside = F.sequence(F.lit(0), F.least(F.lit(RUN - 1), F.col("n") - F.col("base")))
    each = text_runs(texts, text_id, text, width).select("text_id", "base", "run", "edge", F.explode(inside).alias("i"))
    before = F.when(F.col("i") == 0, F.col("edge")).otherwise(F.substring("run", F.col("i"), F.lit(1)))
    return each.select("text_id", (F.col("base") + F.col("i")).alias("pos"), F.substring("run", F.col("i") + 1, F.lit(width)).alias("key"), before.alias("before"))


def by_text(held: DataFrame, width: int, columns: list[T.StructField], work: Callable[[sorting.Sorted], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """(text_id, columns): what the work makes of the sorted suffixes of some texts, with the text's number for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in sorting.chunks(batch.column(1).to_pylist()):
                row, arrays = work(sorting.sort(texts, width))
                table = pa.table([batch.column(0).take(pa.array(row + first)), *arrays], ["text_id", *(c.name for c in columns)])
                yield from table.to_batches(max_chunksize=ROWS)

    return spread(held, "text_id").mapInArrow(rows, T.StructType([T.StructField("text_id", held.schema["text_id"].dataType), *columns]))


def held(texts: DataFrame, text_id: str = "text_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(text_id, text) of the texts that are sorted in memory, and of the others, if any."""
    own = texts.where((F.length(text) > 0) & F.col(text_id).isNotNull()).select(F.col(text_id).alias("text_id"), F.col(text).alias("text"))
    long = own.where(F.length("text") > LONG)
    return own.where(F.length("text") <= LONG), long if long.limit(1).count() else None


def suffixes(texts: DataFrame, text_id: str = "text_id", text: str = "text", *, width: int = WIDTH) -> DataFrame:
    """(text_id, rank, sa, lcp, bwt): all suffixes in order; bwt is null where the suffix is the text."""
    short, long = held(texts, text_id, text)

    def work(s: sorting.Sorted) -> tuple[np.ndarray, list[pa.Array]]:
        return s.row, [*(pa.array(c, pa.int32()) for c in (s.rank, s.sa, s.lcp)), s.characters(s.bwt)]

    numbers = [T.StructField(c, T.IntegerType()) for c in ("rank", "sa", "lcp")]
    out = by_text(short, width, [*numbers, T.StructField("bwt", T.StringType())], work)
    return out if long is None else out.unionByName(joined(long, width))


def bwt_runs(texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(text_id, run, ch, start, length): `runs` of the texts' suffixes, made where they are sorted."""
    short, long = held(texts, text_id, text)

    def work(s: sorting.Sorted) -> tuple[np.ndarray, list[pa.Array]]:
        at = np.flatnonzero(np.concatenate([[True], (s.bwt[1:] != s.bwt[:-1]) | (s.row[1:] != s.row[:-1])]))
        row = s.row[at]
        run = np.arange(len(at)) - np.searchsorted(row, row) + 1
        length = np.diff(np.append(at, len(s.row)))
        return row, [pa.array(run, pa.int64()), s.characters(s.bwt[at]), pa.array(s.rank[at], pa.int32()), pa.array(length, pa.int64())]

    columns = [T.StructField(c, t) for c, t in (("run", T.LongType()), ("ch", T.StringType()), ("start", T.IntegerType()), ("length", T.LongType()))]
    out = by_text(short, WIDTH, columns, work)
    return out if long is None else out.unionByName(runs(joined(long, WIDTH)))


def joined(texts: DataFrame, width: int, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """`suffixes` by joins and windows, for texts of any length."""
    per_text = Window.partitionBy("text_id")
    chars = settle_rows(positions(texts, text_id, text, width), "positions")
    level = settle_rows(chars.select("text_id", "pos", (F.rank().over(per_text.orderBy("key")) - 1).cast("int").alias("r")), "ranks")
    levels, size = [], width
    while level.groupBy("text_id", "r").count().where("count > 1").limit(1).count():
        levels.append((size, level))
        ahead = F.coalesce(F.lead("r", size).over(per_text.orderBy("pos")), F.lit(-1))
        level = settle_rows(level.withColumn("s", ahead).select("text_id", "pos", (F.rank().over(per_text.orderBy("r", "s")) - 1).cast("int").alias("r")), "ranks")
        size *= 2
    order = level.select("text_id", F.col("pos").alias("sa"), F.col("r").alias("rank"))
    pairs = order.withColumn("prev", F.lag("sa").over(per_text.orderBy("rank"))).withColumn("done", F.lit(0))
    for size, ranks in reversed(levels):
        for side in ("sa", "prev"):
            own = ranks.select(F.col("text_id").alias("t"), F.col("pos").alias("p"), F.col("r").alias(f"r_{side}"))
            pairs = pairs.join(own, (F.col("text_id") == F.col("t")) & (F.col(side) + F.col("done") == F.col("p")), "left").drop("t", "p")
        # equal ranks at a level: the next `size` characters agree (the ends of a text never share a rank)
        pairs = pairs.withColumn("done", F.col("done") + F.when(F.col("r_sa") == F.col("r_prev"), size).otherwise(0)).drop("r_sa", "r_prev")
    for side in ("sa", "prev"):
        own = chars.select(F.col("text_id").alias("t"), F.col("pos").alias("p"), F.col("key").alias(f"k_{side}"))
        pairs = pairs.join(own, (F.col("text_id") == F.col("t")) & (F.col(side) + F.col("done") == F.col("p")), "left").drop("t", "p")
    rest = F.coalesce(common_prefix(F.col("k_sa"), F.col("k_prev")), F.lit(0))
    lcps = pairs.select("text_id", "rank", "sa", F.when(F.col("prev").isNull(), 0).otherwise(F.col("done") + rest).cast("int").alias("lcp"))
    letters = chars.select("text_id", F.col("pos").alias("sa"), "before")
    return lcps.join(letters, ["text_id", "sa"]).select("text_id", "rank", "sa", "lcp", F.when(F.col("sa") > 0, F.col("before")).alias("bwt"))


def reversed_texts(texts: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """Reversed texts: their suffix order is the co-lexicographic order of prefixes."""
    return texts.select(F.col(text_id).alias("text_id"), F.reverse(text).alias("text"))


def prefix_array(reversed_suffixes: DataFrame) -> DataFrame:
    """(text_id, rank, end): the prefixes in co-lexicographic order by their last position (0-based), without the empty one."""
    n = F.max("sa").over(Window.partitionBy("text_id"))
    return reversed_suffixes.withColumn("n", n).where(F.col("rank") > 0).select("text_id", "rank", (F.col("n") - F.col("sa") - 1).alias("end"))


def runs(ordered: DataFrame) -> DataFrame:
    """(text_id, run, ch, start, length): maximal runs of the BWT; ch is null for the terminator."""
    w = Window.partitionBy("text_id").orderBy("rank")
    changed = F.when(F.lag("rank").over(w).isNull() | ~F.col("bwt").eqNullSafe(F.lag("bwt").over(w)), 1).otherwise(0)
    numbered = ordered.withColumn("new", changed).withColumn("run", F.sum("new").over(w))
    return numbered.groupBy("text_id", "run").agg(F.min("bwt").alias("ch"), F.min("rank").alias("start"), F.count("*").alias("length"))


def run_counts(ordered: DataFrame) -> DataFrame:
    """(text_id, runs)."""
    return counts_of(runs(ordered))


def counts_of(runs: DataFrame) -> DataFrame:
    """(text_id, runs) of the runs of `runs` or `bwt_runs`."""
    return runs.groupBy("text_id").agg(F.count("*").alias("runs"))


def range_minima(values: DataFrame, value: Column, longest: int) -> DataFrame:
    """(text_id, level, rank, least): minima of 2**level rows from each rank on, up to the longest range asked."""
    w = Window.partitionBy("text_id").orderBy("rank")
    table = values.select("text_id", "rank", value.alias("least")).withColumn("level", F.lit(0))
    out, level = table, 0
    while 1 << (level + 1) <= longest:
        further = F.lead("least", 1 << level).over(w)
        table = table.withColumn("least", F.when(further.isNotNull(), F.least("least", further))).where(F.col("least").isNotNull()).withColumn("level", F.lit(level + 1))
        out, level = out.unionByName(table), level + 1
    return out
