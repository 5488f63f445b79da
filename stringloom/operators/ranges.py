"""All suffixes of a collection in order, by ranges of their first bytes: the way of corpus.py for keys that few suffixes share.

UTF-8 keeps the order of characters, so suffixes are told apart by bytes. A task that holds
texts deals out their suffixes to ranges, packed: per range and batch one compressed row of
first bytes, texts, positions and characters before. The task of a range sorts its suffixes in
numpy and knows the common prefixes of those that differ. Only suffixes that share all these
bytes go on: they ask the texts for longer and longer pieces, group by group.

Ranges are those of a sample, which with a row per range is all that the driver gets. No range
begins inside a key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import common_prefix
from ..session import forget, settle, settle_rows, small_bytes
from .suffix import RUN, text_runs

#: Sampled keys of a range. One that half as many ranges as HEAVY would hold is left to corpus.py.
SAMPLE, HEAVY = 32, 4

#: Bytes whose positions are dealt out together.
STEP = 1 << 20

#: Characters of the first and of the longest pieces; of all pieces of a round, per character of the collection.
PIECE, LONGEST, VOLUME = 32, 512, 8

#: Words, bytes left, text_id, position and character before, of some suffixes.
Pieces = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _heads(ids: np.ndarray, texts: pa.Array, words: int) -> Pieces:
    """(words, left, text_id, pos, before) of the positions of non-empty texts: their first bytes as big-endian numbers, a row a word, and the bytes left, up to one more than that."""
    size, ends = 8 * words, np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    gap = size + 8  # zero bytes behind each text
    lengths = np.diff(ends)
    begins = np.concatenate([[0], np.cumsum(lengths + gap)])
    whole = np.zeros(begins[-1] + gap, np.uint8)
    for to, a, b in zip(begins.tolist(), ends.tolist(), ends[1:].tolist()):
        whole[to : to + b - a] = data[a:b]
    for first in range(0, begins[-1], STEP):
        last = min(first + STEP, int(begins[-1]))
        row = np.arange(*np.searchsorted(begins, [first, last], "right") + [-1, 0])
        row = row[row < len(lengths)]
        a, b = np.maximum(begins[row], first), np.minimum(begins[row] + lengths[row], last)
        n = np.maximum(b - a, 0)
        row, at = np.repeat(row, n), np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        starts = (whole[at] & 0xC0) != 0x80
        row, at = row[starts], at[starts]
        if not len(at):
            continue
        part = whole[first : last + gap]
        head = np.empty(len(part) - 8, np.uint64)
        for o in range(8):
            m = len(head[o::8])
            head[o::8] = part[o : o + 8 * m].view(">u8")
        keys = np.stack([head[at - first + 8 * w] for w in range(words)])
        # characters before: those of the text, and where the slice begins inside it, those ahead of the slice
        order = np.arange(len(at)) - np.searchsorted(row, row)
        ahead = int(np.count_nonzero((whole[begins[row[0]] : at[0]] & 0xC0) != 0x80))
        pos = order + np.where(row == row[0], ahead, 0)
        back = np.zeros(len(at), np.int64)  # the bytes of the character before, as a number
        for k in range(4, 0, -1):
            inside = at - k >= begins[row]
            byte = np.where(inside, whole[np.maximum(at - k, 0)], 0).astype(np.int64)
            back = np.where(inside & ((byte & 0xC0) != 0x80), 0, back) << 8 | byte  # a later start begins anew
        yield keys, np.minimum(begins[row] + lengths[row] - at, size + 1).astype(np.int16), ids[row], pos.astype(np.int32), back.astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """The numbers, byte by byte of each."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _numbers(data: memoryview, dtype: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, n).T).view(dtype).ravel()


CODEC = "zstd"


def _pack(keys: np.ndarray, left: np.ndarray, ids: np.ndarray, pos: np.ndarray, back: np.ndarray) -> bytes:
    spelled = np.ascontiguousarray(keys.T).astype(">u8").tobytes()
    return pa.compress(spelled + _planes(left) + _planes(np.diff(ids, prepend=0)) + _planes(pos) + _planes(back), CODEC, asbytes=True)


def _unpack(packed: bytes, n: int, words: int) -> tuple[np.ndarray, ...]:
    data, at, out = memoryview(pa.decompress(packed, n * (8 * words + 18), CODEC, asbytes=True)), 8 * words * n, []
    keys = np.frombuffer(data[:at], ">u8").reshape(n, words).T.astype(np.uint64)
    for dtype in (np.int16, np.int64, np.int32, np.uint32):
        size = np.dtype(dtype).itemsize * n
        out.append(_numbers(data[at : at + size], dtype, n))
        at += size
    left, ids, pos, back = out
    return keys, left, np.cumsum(ids), pos, back


def _spelled(keys: np.ndarray) -> np.ndarray:
    """Keys as byte strings, which compare as the words do."""
    return np.ascontiguousarray(keys.T).astype(">u8").view(f"S{8 * len(keys)}").ravel()


def _range_of(keys: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many of the sorted borders, byte strings, are not above each key."""
    size = 8 * len(keys)
    first = np.frombuffer(b"".join(b[:8].ljust(8, b"\0") for b in borders.tolist()), ">u8").astype(np.uint64)
    out = np.searchsorted(first, keys[0], "left")
    unsure = np.flatnonzero(out != np.searchsorted(first, keys[0], "right"))
    if len(unsure):
        out[unsure] = np.searchsorted(borders.astype(f"S{size}"), _spelled(keys[:, unsure]), "right")
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes two keys have in common, and how many whole characters these are; words by rows."""
    n, words = a.shape[1], len(a)
    size = np.zeros(n, np.int32)
    open_ = np.ones(n, bool)
    for w in range(words):
        differ = (a[w] ^ b[w]) if n else a[w]
        same = np.full(n, 8, np.int32)
        for k in range(8):  # the first byte that differs
            same = np.where((same == 8) & ((differ >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0), k, same)
        size += np.where(open_, same, 0)
        open_ &= same == 8
    return size, _characters(a, size)


def _characters(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whole characters among the first bytes of the keys, if these end at a character's end or inside one."""
    out = size.astype(np.int32).copy()
    high = np.uint64(0x8080808080808080)
    odd = np.flatnonzero(np.any(keys & high != 0, axis=0))
    if len(odd):
        spelled = np.ascontiguousarray(keys[:, odd].T).astype(">u8").view(np.uint8).reshape(len(odd), -1)
        starts = np.concatenate([(spelled & 0xC0) != 0x80, np.ones((len(odd), 1), bool)], axis=1)
        some = size[odd]
        count = (np.cumsum(starts, axis=1) - starts)[np.arange(len(odd)), some]
        lead = spelled[np.arange(len(odd)), :]
        # the last character that began is whole if its bytes, as its first one tells, end here
        last = np.where(starts[:, :-1] & (np.arange(lead.shape[1]) < some[:, None]), np.arange(lead.shape[1]), -1).max(axis=1)
        byte = lead[np.arange(len(odd)), np.maximum(last, 0)].astype(np.int64)
        width = np.where(byte >= 0xF0, 4, np.where(byte >= 0xE0, 3, np.where(byte >= 0xC0, 2, 1)))
        out[odd] = count - ((last >= 0) & (last + width > some))
    return out


def _letters(back: np.ndarray) -> pa.Array:
    """The characters whose bytes are the numbers; null for 0xFFFFFFFF, which is a text's start."""
    kinds, number = np.unique(back, return_inverse=True)
    spelled = [None if x == NOTHING else int(x).to_bytes(max(1, (int(x).bit_length() + 7) // 8), "big").decode() for x in kinds]
    return pa.array(spelled, pa.string()).take(pa.array(number))


#: No character before.
NOTHING = 0xFFFFFFFF


def _sorted_range(part: int, held: tuple[np.ndarray, ...]) -> pa.Table:
    keys, left, ids, pos, back = held
    size = 8 * len(keys)
    order = np.lexsort((pos, ids, left, *keys[::-1]))
    keys, left, ids, pos, back = keys[:, order], left[order], ids[order], pos[order], back[order]
    n = len(order)
    lcp, same = np.zeros(n, np.int32), np.zeros(n, bool)
    common, _ = _shared(keys[:, 1:], keys[:, :-1])
    least = np.minimum(left[1:], left[:-1])
    same[1:] = (common == size) & (least > size)
    lcp[1:] = _characters(keys[:, 1:], np.minimum(common, least).astype(np.int32))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    tied = same.copy()
    tied[:-1] |= same[1:]
    done = pa.array(_characters(keys, np.full(n, size, np.int32)), pa.int32(), mask=~tied)
    edge = np.full(n, None, object)
    for i in (0, n - 1):
        edge[i] = _spelled(keys[:, i : i + 1])[0].ljust(size, b"\0")[: min(int(left[i]), size)]
    place = np.where(tied, first, np.arange(n))
    columns = [pa.array(np.full(n, part), pa.int32()), pa.array(place, pa.int32()), pa.array(ids), pa.array(pos), pa.array(np.where(tied, lcp[first], lcp), pa.int32()), _letters(back), done, pa.array(edge, pa.binary())]
    return pa.table(columns, ["part", "place", "text_id", "pos", "lcp", "bwt", "done", "edge"])


SORTED = "part int, place int, text_id long, pos int, lcp int, bwt string, done int, edge binary"


def _batches(texts: DataFrame, words: int, schema: str, work) -> DataFrame:
    """What the work makes of (words, left, text_id, pos, before) of some positions at a time, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.string())
                # some texts of about STEP bytes at a time
                step = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // STEP
                cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
                for a, b in pairwise(cuts):
                    for found in _heads(ids[a:b], texts.slice(a, b - a), words):
                        found[4][found[3] == 0] = NOTHING
                        yield from work(*found)

    return texts.mapInArrow(run, schema)


def _borders(texts: DataFrame, words: int, ranges: int, n: int) -> list[bytes] | None:
    """Keys at which ranges begin; None if one key would fill ranges."""
    if ranges == 1:
        return []
    stride = max(1, n // (ranges * SAMPLE))

    def sampled(keys, left, ids, pos, back):
        at = np.flatnonzero((np.abs(ids) * 1_000_003 + pos) % stride == 0)
        yield pa.RecordBatch.from_arrays([pa.array(_spelled(keys[:, at]).tolist(), pa.binary())], ["key"])

    keys = sorted(bytes(r[0]) for r in _batches(texts, words, "key binary", sampled).collect())
    if not keys or max(Counter(keys).values()) * 2 > SAMPLE * HEAVY:
        return None
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})


def suffixes(texts: DataFrame, rows: int, text_id: str, text: str, width: int) -> DataFrame | None:
    """(rank, text_id, pos, lcp, bwt) of corpus.suffixes, from ranges of about so many rows; None if keys or what is compared beyond them would take too much."""
    spark = texts.sparkSession
    if not isinstance(texts.schema[text_id].dataType, T.IntegralType):
        return None
    small_bytes(spark)
    held = texts.where((F.length(text) > 0) & F.col(text_id).isNotNull()).select(F.col(text_id).cast("long").alias("text_id"), F.col(text).alias("text"))
    n = held.agg(F.sum(F.length("text"))).first()[0]
    if not n:
        return None
    words, ranges = ceil(width / 8), ceil(n / rows)
    found = _borders(held, words, ranges, n)
    if found is None:
        return None
    borders = np.array(found, object)

    def dealt(keys, left, ids, pos, back):
        part = _range_of(keys, np.array(borders.tolist(), f"S{8 * words}")) if len(borders) else np.zeros(len(ids), np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = order[a:b]
            packed = _pack(keys[:, at], left[at], ids[at], pos[at], back[at])
            yield pa.RecordBatch.from_arrays([pa.array([part[at[0]]], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([packed], pa.binary())], ["part", "n", "packed"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wait = None, []
        for batch in batches:
            for part, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != own and wait:
                    yield from _ready(own, wait, words)
                    wait = []
                own = part
                wait.append((packed, size))
        if wait:
            yield from _ready(own, wait, words)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(ranges, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = _batches(held, words, "part int, n int, packed binary", dealt)
    order = settle(packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(sort, SORTED), "suffixes", **COMPACT)

    sizes = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.count("*").alias("n")).collect()}
    edges = {part: [] for part in sizes}
    for r in order.where("edge is not null").select("part", "edge").collect():
        edges[r["part"]].append(bytes(r["edge"]))
    bases, before, last = [], 0, None
    for part in sorted(sizes):
        low, high = min(edges[part]), max(edges[part])
        bases.append((part, before, 0 if last is None else _common_characters(last, low)))
        before, last = before + sizes[part], high
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long, head int"))
    met = order.join(base, "part").withColumn("lcp", F.when(F.col("place") == 0, F.col("head")).otherwise(F.col("lcp"))).withColumn("rank", F.col("base") + F.col("place"))
    out = met.where("done is null").select("rank", "text_id", "pos", "lcp", "bwt")
    state = settle_rows(met.where("done is not null").select("rank", "text_id", "pos", "lcp", "bwt", "done"), "tied")
    piece = PIECE
    while size := state.count():
        if size * piece > VOLUME * n:
            forget(order)
            return None
        told = settle_rows(_told(state, held, piece), "told")
        forget(state)
        out = out.unionByName(told.where("done is null").select("rank", "text_id", "pos", "lcp", "bwt"))
        state = settle_rows(told.where("done is not null"), "tied")
        piece = min(2 * piece, LONGEST)
    return out.withColumn("text_id", F.col("text_id").cast(texts.schema[text_id].dataType))


#: How sorted suffixes are written: places take no room as differences.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2"}


def _ready(part: int, wait: list[tuple[bytes, int]], words: int) -> Iterator[pa.RecordBatch]:
    n, at = sum(size for _, size in wait), 0
    held = (np.empty((words, n), np.uint64), *(np.empty(n, t) for t in (np.int16, np.int64, np.int32, np.uint32)))
    for packed, size in wait:
        for whole, some in zip(held, _unpack(packed, size, words), strict=True):
            whole[..., at : at + size] = some
        at += size
    wait.clear()
    table = _sorted_range(part, held)
    yield from table.combine_chunks().to_batches(max_chunksize=100_000)


def _common_characters(a: bytes, b: bytes) -> int:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return len(a[:n].decode("utf-8", "ignore"))


def _told(state: DataFrame, texts: DataFrame, piece: int) -> DataFrame:
    """Groups of suffixes (rank of the first, text_id, pos, lcp of the first, bwt, characters done) by their next piece: places and common prefixes of those told apart, and smaller groups; done is null for the former."""
    runs = text_runs(texts, "text_id", "text", piece).select("text_id", "base", "run")
    at = F.col("pos") + F.col("done")
    asked = state.withColumn("base", (F.floor(at / RUN) * RUN).cast("int"))
    met = asked.join(runs.hint("merge"), ["text_id", "base"]).withColumn("piece", F.substring("run", at - F.col("base") + 1, F.lit(piece))).drop("run", "base")
    group, equal = Window.partitionBy("rank").orderBy("piece", "text_id", "pos"), Window.partitionBy("rank", "piece")
    ordered = met.withColumn("place", F.row_number().over(group) - 1).withColumn("prev", F.lag("piece").over(group))
    begins = F.col("prev").isNull() | (F.col("prev") != F.col("piece"))
    head = F.when(F.col("prev").isNull(), F.col("lcp")).otherwise(F.col("done") + common_prefix(F.col("piece"), F.col("prev")))
    each = ordered.withColumn("begins", begins).withColumn("head", F.when(begins, head))
    each = each.withColumn("c", F.count("*").over(equal)).withColumn("first", F.min("place").over(equal)).withColumn("head", F.max("head").over(equal))
    over = (F.col("c") == 1) | (F.length("piece") < piece)
    rank = F.col("rank") + F.when(over, F.col("place")).otherwise(F.col("first"))
    lcp = F.when(over & ~F.col("begins"), F.col("done") + F.length("piece")).otherwise(F.col("head")).cast("int")
    return each.select(rank.alias("rank"), "text_id", "pos", lcp.alias("lcp"), "bwt", F.when(~over, F.col("done") + piece).cast("int").alias("done"))
