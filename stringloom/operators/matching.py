"""Maximal exact matches of a set of patterns in all texts together, by one pass over the texts.

The keys of all pattern positions (their next `width` characters) are sorted. Every text
position takes its place among them: the key just before or just after it shares the longest
prefix, and that prefix is the longest match of this text position with any pattern. Per
task, only the first text position of each matched prefix leaves it, so what is shuffled
grows with the patterns, not with the texts; only matches of a whole key leave one by one.
Those that follow one another on a diagonal (text position less pattern position) are one
match. A prefix that is matched at a text position also matches all shorter ones there: the
longest prefix of a pattern position among all matched prefixes is its matching statistic.

The keys reach the tasks in blocks of at most BLOCK keys; more keys take more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .ranking import ranked

WIDTH = 16

#: Keys of a pass over the texts: WIDTH characters each, sent to every task.
BLOCK = 200_000

#: Text positions that are placed at a time.
STEP = 1 << 17


class Keys:
    """Sorted distinct keys of at most `width` characters, as numbers, for many text positions to be placed among.

    Characters of the keys are numbered from 1 in order; all others share the next number and
    0 ends a key, so that neither is ever equal to a text's character. The first characters
    of a key fill 64 bits, and only positions that share them all are compared further.
    """

    def __init__(self, keys: list[str], width: int):
        self.width, self.n = width, len(keys)
        points = [np.frombuffer(k.encode("utf-32-le"), np.uint32) for k in keys]
        alphabet = np.unique(np.concatenate(points))
        self.other = len(alphabet) + 1
        self.number = np.full(0x110000, self.other, np.uint32)
        self.number[alphabet] = np.arange(1, self.other)
        self.rows = np.zeros((self.n, width), np.uint32)
        for row, p in zip(self.rows, points, strict=True):
            row[: len(p)] = self.number[p]
        self.bits = next(b for b in (8, 16, 32) if self.other >> b == 0)
        self.head = min(width, 64 // self.bits)
        self.heads, self.first = np.unique(self._packed(self.rows.T), return_index=True)
        self.whole = _as_bytes(self.rows)

    def _packed(self, columns) -> np.ndarray:
        """The first characters, given one array for each, as one number per row."""
        out = np.zeros(len(columns[0]), np.uint64)
        for k in range(self.head):
            out |= columns[k].astype(np.uint64) << np.uint64(64 - self.bits * (k + 1))
        return out

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many characters two packed heads share from the start."""
        differ, out = a ^ b, np.zeros(len(a), np.int64)
        for k in range(self.head):
            out += differ >> np.uint64(64 - self.bits * (k + 1)) == 0
        return out

    def longest_shared(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first position, key, length) for runs of positions: a key that shares the longest prefix with the text there, and how long it is."""
        codes = np.concatenate([self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)], np.full(self.width, self.other, np.uint32)])
        for first in range(0, len(text), STEP):
            n = min(STEP, len(text) - first)
            head = self._packed([codes[first + k : first + k + n] for k in range(self.head)])
            after = np.searchsorted(self.heads, head)
            low, high = np.maximum(after - 1, 0), np.minimum(after, len(self.heads) - 1)
            n_low, n_high = self._shared(self.heads[low], head), self._shared(self.heads[high], head)
            key, size = self.first[np.where(n_high > n_low, high, low)], np.maximum(n_low, n_high)
            further = np.flatnonzero(size == self.head) if self.head < self.width else size[:0]
            if len(further):
                rows = codes[first + further[:, None] + np.arange(self.width)]
                place = np.searchsorted(self.whole, _as_bytes(rows))
                for at in (np.maximum(place - 1, 0), np.minimum(place, self.n - 1)):
                    differ = self.rows[at] != rows
                    full = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
                    better = full >= size[further]
                    key[further[better]], size[further[better]] = at[better], full[better]
            yield first, key, size


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings of the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def _placed(texts: DataFrame, keys: list[str], base: int, width: int) -> DataFrame:
    """(key, len, text_id, pos): the first position per task batch of each matched prefix, every position of whole keys. keys: sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Keys(keys, width)
        for batch in batches:
            ids, found = batch.column(0), []
            seen = np.zeros(table.n * (width + 1), bool)
            for row in pc.sort_indices(ids).to_pylist():
                for first, key, size in table.longest_shared(batch.column(1)[row].as_py()):
                    code = key * (width + 1) + size
                    new = np.flatnonzero((size > 0) & (size < width) & ~seen[code])
                    new = new[np.unique(code[new], return_index=True)[1]]
                    seen[code[new]] = True
                    at = np.concatenate([new, np.flatnonzero(size == width)])
                    found.append((code[at], np.full(len(at), row), at + first))
            code, row, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(code // (width + 1) + base, pa.int64()), pa.array(code % (width + 1), pa.int32()), ids.take(pa.array(row)), pa.array(pos, pa.int32())], names=["key", "len", "text_id", "pos"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("len", T.IntegerType()), T.StructField("text_id", texts.schema["text_id"].dataType), T.StructField("pos", T.IntegerType())])
    return texts.mapInArrow(work, schema)


def place(keys: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, len, text_id, pos) of a settled table of distinct sorted keys (place from 1, chars), over blocks of keys."""
    size, out = keys.count(), None
    for low in range(0, size, BLOCK):
        block = [r["chars"] for r in keys.where((F.col("place") > low) & (F.col("place") <= low + BLOCK)).orderBy("place").select("chars").collect()]  # BLOCK keys at most
        part = _placed(texts, block, low + 1, width)
        out = part if out is None else out.unionByName(part)
    return out


def mems_in(patterns: DataFrame, texts: DataFrame, pattern_id: str = "pattern_id", seq: str = "seq", text_id: str = "text_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(pattern_id, start, len, text_id, text_pos): the maximal exact matches of each pattern in all the texts together.

    The place is the first by text and position; a character that no text holds gives
    (start, 0, null, -1). pattern_id and text_id are keys; rows whose text_id is null take no part.
    Null and empty patterns and texts give no rows.
    """
    own = patterns.where(F.length(seq) > 0).select(F.col(pattern_id).alias("pattern_id"), F.col(seq).alias("seq"))
    asked = own.select("pattern_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("start")).select("pattern_id", "start", F.substring("seq", F.col("start") + 1, F.lit(width)).alias("chars"))
    asked = settle(asked, "mems-asked")
    keys = settle(ranked(asked.select("chars").distinct(), ["chars"], "place"), "mems-keys")
    held = texts.where((F.length(text) > 0) & F.col(text_id).isNotNull()).select(F.col(text_id).alias("text_id"), F.col(text).alias("text"))
    placed = place(keys, held, width)
    if placed is None:
        nothing = held.select("text_id").where(F.lit(False))
        return own.where(F.lit(False)).select("pattern_id", F.lit(0).alias("start"), F.lit(0).alias("len")).crossJoin(nothing).withColumn("text_pos", F.lit(0))
    placed = settle(placed.join(keys.select(F.col("place").alias("key"), "chars"), "key").select("chars", "len", "text_id", "pos"), "mems-placed")

    # whole keys: runs along a diagonal
    whole = placed.where(F.col("len") == width).join(asked, "chars").select("pattern_id", "text_id", "start", (F.col("pos") - F.col("start")).alias("diagonal"))
    run = F.col("start") - F.row_number().over(Window.partitionBy("pattern_id", "text_id", "diagonal").orderBy("start"))
    runs = whole.withColumn("run", run).groupBy("pattern_id", "text_id", "diagonal", "run").agg(F.min("start").alias("start"), F.max("start").alias("last"))
    longest = F.min(F.struct((F.col("start") - F.col("last") - width).alias("less"), "text_id", (F.col("start") + F.col("diagonal")).alias("pos")))
    spans = runs.groupBy("pattern_id", "start").agg(longest.alias("m")).select("pattern_id", "start", (F.col("start") - F.col("m.less")).alias("own_end"), F.col("m.text_id").alias("far_text"), F.col("m.pos").alias("far_pos"))

    # shorter ones: the longest prefix of each key among all matched prefixes, with its first place
    prefixes = lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: F.expr("chars").substr(F.lit(1), k))
    matched = placed.groupBy("chars", "len").agg(F.min(F.struct("text_id", "pos")).alias("f"))
    first = matched.select(F.explode(prefixes(F.col("len"))).alias("prefix"), "f").groupBy("prefix").agg(F.min("f").alias("f"))
    best = keys.select("chars", F.explode(prefixes(F.length("chars"))).alias("prefix")).join(first, "prefix").groupBy("chars").agg(F.max_by(F.struct(F.length("prefix").alias("len"), F.col("f.text_id").alias("text_id"), F.col("f.pos").alias("pos")), F.length("prefix")).alias("near"))

    upto = Window.partitionBy("pattern_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    states = asked.join(best, "chars", "left").join(spans, ["pattern_id", "start"], "left").withColumn("end", F.coalesce(F.max("own_end").over(upto), F.lit(0)))
    far = F.col("end") - F.col("start") >= width
    each = states.select("pattern_id", "start", F.when(far, F.col("end") - F.col("start")).otherwise(F.coalesce("near.len", F.lit(0))).alias("len"), F.when(far, F.col("far_text")).otherwise(F.col("near.text_id")).alias("text_id"), F.when(far, F.col("far_pos")).otherwise(F.col("near.pos")).alias("pos"))
    before = F.lag("len").over(Window.partitionBy("pattern_id").orderBy("start"))
    kept = each.withColumn("before", before).where((F.col("len") == 0) | F.col("before").isNull() | (F.col("before") <= F.col("len")))
    return kept.select("pattern_id", "start", F.col("len").cast("int").alias("len"), "text_id", F.coalesce("pos", F.lit(-1)).cast("int").alias("text_pos"))
