"""Language-model scoring: prediction by partial matching over bytes, and a word base line.

The byte model is a trie of contexts of up to ORDER bytes, kept level by level as tables of
(context, next symbol, count); 0 is the border before and after a text, byte b is b + 1.
The probability of a symbol follows PPM with method C: in the longest context seen, a symbol
has count / (total + distinct), the escape distinct / (total + distinct); after an escape,
the symbols of the longer context are excluded from the shorter one's total and distinct,
down to an even choice among the symbols that no context has excluded. As the model is
pretrained, a symbol's probability depends on its ORDER + 1 symbols only, so it is worked
out once per distinct gram, by joins between the levels, and summed up per document.

Jobs: the documents are laid down in blocks of about BLOCK_BYTES; every block lists its
distinct words (as 64-bit hashes) and grams with their counts in training texts; the counts
are summed over all blocks by a shuffle; the grams' and words' logarithms go back to the
blocks that asked for them, packed by block, and each block scores its own documents, piece by
piece, once its answers are there. A word that only one
block holds needs no answer: that block's own count is the whole one. So no task and no
broadcast holds the whole model, and what is gathered grows with the corpus.

Words are runs of other than ASCII white space, with A-Z lower-cased; each text is followed
by an end token. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))).

Defined cases: a null text is empty: it has the end token and the end symbol only; without
training texts N, V and every c are 0 and the byte model is the even choice; a null doc_id
falls in a fold as the empty text does; repeated rows are counted and scored each; other
columns are kept, but for those that have the name of a result, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .shared import forget, fresh, settle, settle_dealt, small_bytes, trim

ORDER = 6
SYMBOLS = 257
BLOCK_BYTES = 40 << 20
CHUNK = 1 << 19
#: A block's codes are in order, so their differences take less room.
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#code": "false"}

#: What a block gets, in this order: answers for words and for grams, then its rows.
WORD, GRAM, ROWS = 0, 1, 2
#: Stands for the end token among the word hashes.
END = 0x5E0FD0C5


def grams(column: pa.Array, order: int = ORDER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, gram codes, codes per row) of runs of rows; a long text comes in several runs."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, buffer = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)

    def codes(symbols: np.ndarray) -> np.ndarray:
        out = symbols[: len(symbols) - order].astype(np.int64)
        for j in range(1, order + 1):
            out *= SYMBOLS
            out += symbols[j : len(symbols) - order + j]
        return out

    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        last = min(last, row + max(1, CHUNK // 64))
        if at[last] - at[row] <= 2 * CHUNK:
            lengths = np.diff(at[row : last + 1])
            symbols = np.zeros(order + int(lengths.sum()) + order * len(lengths), np.int16)
            where = np.arange(int(lengths.sum())) + order * (1 + np.repeat(np.arange(len(lengths)), lengths))
            symbols[where] = data[at[row] : at[last]].astype(np.int16) + 1
            every = codes(symbols)  # code i predicts symbol i + order
            firsts = np.concatenate([[0], np.cumsum(lengths + order)[:-1]])
            wanted = np.arange(int((lengths + 1).sum())) + np.repeat(firsts - np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1)
            yield row, every[wanted], lengths + 1
        else:
            whole = data[at[row] : at[last]]
            for a in range(0, len(whole), CHUNK):
                b = min(len(whole), a + CHUNK)
                part = np.zeros(order + b - a + (b == len(whole)), np.int16)
                part[max(0, order - a) : order + b - a] = whole[max(0, a - order) : b].astype(np.int16) + 1
                out = codes(part)
                yield row, out, np.array([len(out)])
        row = last


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.diff(np.append(first, len(codes)))


class _Tally:
    """Distinct codes with counts (32 bits: a block has fewer symbols). RAW codes are sorted together; what came in since is merged in once it is half of them, LEAST at least."""

    LEAST = 500_000
    RAW = 1 << 21

    def __init__(self):
        self.parts, self.size, self.merged = [], 0, 0
        self.raw, self.held = {True: [], False: []}, 0

    def add(self, codes: np.ndarray, train: np.ndarray) -> None:
        for own, counted in ((codes[train], True), (codes[~train], False)):
            self.raw[counted].append(own)
        self.held += len(codes)
        if self.held >= self.RAW:
            self.sort()
            if self.size - self.merged > max(self.LEAST, self.merged // 2):
                self.merge()

    def sort(self) -> None:
        for counted, own in self.raw.items():
            if sum(map(len, own)):
                u, c = _counted(np.concatenate(own))
                self.parts.append((u, c.astype(np.int32) if counted else np.zeros(len(u), np.int32)))
                self.size += len(u)
            own.clear()
        self.held = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        self.sort()
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        codes, counts = [list(x) for x in zip(*self.parts)]
        self.parts = []
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")  # runs in order are merged, not sorted anew
        codes = codes[order]
        counts = np.concatenate(counts)[order]
        del order
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        codes, counts = codes[first], np.add.reduceat(counts, first, dtype=np.int32)
        self.parts, self.size, self.merged = [(codes, counts)], len(codes), len(codes)
        trim()
        return codes, counts


def lay_down(docs: DataFrame, text: str, number: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with their block's number, written to the shared folder."""
    schema = T.StructType([*docs.schema.fields, T.StructField(number, T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = batch.column(text).cast(pa.large_string())
            lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, sizes.offset * 8)) if len(sizes) else np.empty(0, np.int64)
            block_of = block + (filled + np.cumsum(lengths) - lengths) // block_bytes
            filled += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block_of.astype(np.int64))], names=schema.names)
        trim()

    return settle(docs.mapInArrow(run, schema), "lm-blocks")


def tally(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, code, block, n): the distinct words and grams of each block (block, train, text), n: in training texts."""

    def run(batches):
        block, words, symbols = None, _Tally(), _Tally()

        def out():
            for kind, t in ((WORD, words), (GRAM, symbols)):
                codes, counts = t.merge()
                for a in range(0, len(codes), 100_000):
                    part = slice(a, a + 100_000)
                    m = len(codes[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(codes[part]), pa.array(np.full(m, block, np.int64)), pa.array(counts[part].astype(np.int64))], names=["kind", "code", "block", "n"])

        for whole in batches:
            numbers = whole.column("block").to_numpy()
            for own in np.unique(numbers):
                if own != block:
                    if block is not None:
                        yield from out()
                    block, words, symbols = int(own), _Tally(), _Tally()
                    trim()
                where = np.flatnonzero(numbers == own)
                batch = whole.slice(where[0], len(where))
                train, column = batch.column("train").to_numpy(zero_copy_only=False), batch.column("text")
                for first, last, hashes, counts in textscan.segments(column, textscan.SPACED):
                    words.add(hashes.view(np.int64), np.repeat(train[first:last], counts))
                words.add(np.full(len(train), END, np.int64), train)
                for first, codes, counts in grams(column, order):
                    symbols.add(codes, np.repeat(train[first : first + len(counts)], counts))
        if block is not None:
            yield from out()
        words = symbols = None
        trim()

    return blocks.mapInArrow(run, "kind int, code long, block long, n long")


def gram_scores(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[DataFrame]]:
    """(code, value): log10 of each gram's probability, and the tables it is read from.

    grams: (code, c), c being the count in training texts, 0 for a gram that only others hold.
    A context's symbols are a window of at most SYMBOLS rows, so grams that were seen are done
    in one pass; the others go down the orders. Levels whose codes number at most SYMBOLS
    squared are broadcast: their keys are few and hot.
    """
    power = [SYMBOLS**k for k in range(order + 2)]

    def held(df: DataFrame, symbols: int) -> DataFrame:
        return F.broadcast(df) if symbols <= 2 else df

    levels = {order: grams.where("c > 0")}
    for k in range(order - 1, -1, -1):
        levels[k] = settle(levels[k + 1].groupBy((F.col("code") % power[k + 1]).alias("code")).agg(F.sum("c").alias("c")), "lm-level")

    def below(grams_k: DataFrame, k: int) -> DataFrame:
        """grams_k with low_c: the count of the gram one level down."""
        if not k:
            return grams_k.withColumn("low_c", F.lit(0).cast("long"))
        lower = levels[k - 1].select(F.col("code").alias("low"), F.col("c").alias("low_c"))
        return grams_k.join(held(lower, k), F.col("code") % power[k] == F.col("low"))

    stats = {}
    for k in range(order):
        grams_k = below(levels[k].select(F.expr(f"code div {SYMBOLS}").alias("ctx"), "code", "c"), k)
        stats[k] = grams_k.groupBy("ctx").agg(F.sum("c").alias("total"), F.count("*").alias("distinct"), F.sum("low_c").alias("below"))

    w = Window.partitionBy("ctx")
    own = grams.select("code", F.expr(f"code div {SYMBOLS}").alias("ctx"), F.when(F.col("c") > 0, F.col("c")).alias("c"))
    counted = own.select("code", "ctx", "c", F.sum("c").over(w).alias("total"), F.count("c").over(w).alias("distinct"), (F.count("*").over(w) > F.count("c").over(w)).alias("open"))
    kept = [F.when(F.col("open"), F.col(x)).alias(x) for x in ("ctx", "c", "total", "distinct")]
    first = settle(counted.select("code", F.log10(F.col("c") / (F.col("total") + F.col("distinct"))).alias("value"), *kept), "lm-grams", DELTAS)
    around = below(first.where(F.col("ctx").isNotNull() & F.col("c").isNotNull()).select("ctx", "code"), order).groupBy("ctx").agg(F.sum("low_c").alias("below"))
    zero = F.lit(0).cast("long")
    escape = F.when(F.col("total").isNotNull(), F.log10(F.col("distinct") / (F.col("total") + F.col("distinct")))).otherwise(0.0)
    novel = first.where(F.col("value").isNull()).join(around, "ctx", "left")
    state = solved = settle(novel.select("code", escape.alias("acc"), F.coalesce("below", zero).alias("x_total"), F.col("distinct").alias("x_distinct"), F.lit(None).cast("double").alias("value")), "lm-novel")
    for k in range(order - 1, -1, -1):
        level = levels[k].select(F.col("code").alias("g"), F.col("c"))
        stat = stats[k].withColumnRenamed("ctx", "s")
        joined = state.join(held(level, k + 1), F.col("code") % power[k + 1] == F.col("g"), "left").join(held(stat, k), F.expr(f"(code div {SYMBOLS}) % {power[k]}") == F.col("s"), "left")
        total, distinct = F.col("total") - F.col("x_total"), F.col("distinct") - F.col("x_distinct")
        here = F.col("value").isNull() & F.col("s").isNotNull()
        state = joined.select(
            "code",
            F.when(here & F.col("c").isNull() & (total > 0), F.col("acc") + F.log10(distinct / (total + distinct))).otherwise(F.col("acc")).alias("acc"),
            F.when(F.col("s").isNotNull(), F.col("below")).otherwise(F.col("x_total")).alias("x_total"),
            F.when(F.col("s").isNotNull(), F.col("distinct")).otherwise(F.col("x_distinct")).alias("x_distinct"),
            F.when(here & F.col("c").isNotNull(), F.col("acc") + F.log10(F.col("c") / (total + distinct))).otherwise(F.col("value")).alias("value"),
        )
    even = F.col("acc") - F.log10(F.lit(float(SYMBOLS)) - F.col("x_distinct"))
    out = first.where(F.col("value").isNotNull()).select("code", "value").unionByName(state.select("code", F.coalesce("value", even).alias("value")))
    return out, [first, solved, *(levels[k] for k in range(order))]


#: Answers that a task gathers before it packs them by block.
PACKED = 1 << 20


def pack(answers: DataFrame) -> DataFrame:
    """(block, kind, codes, levels, places): answers (kind, code, block, value) of a block together, compressed.

    Codes are kept as differences, values as places among the distinct values, both by bytes.
    """

    def run(batches):
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3).compress
        wait, held = [], 0

        def out():
            nonlocal wait, held
            table = pa.Table.from_batches(wait)
            kind, code, block, value = (table.column(c).to_numpy() for c in ("kind", "code", "block", "value"))
            wait, held = [], 0
            order = np.lexsort((code, kind, block))
            kind, code, block, value = kind[order], code[order], block[order], value[order]
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(block)]
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                levels, places = np.unique(value[a:b], return_inverse=True)
                planes = [np.ascontiguousarray(x.view(np.uint8).reshape(b - a, -1).T) for x in (np.diff(code[a:b], prepend=0), places.astype(np.uint32))]
                rows.append((int(block[a]), int(kind[a]), shrink(planes[0]), shrink(levels), shrink(planes[1])))
            kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "kind", "codes", "levels", "places"])

        for batch in batches:
            wait.append(batch)
            held += batch.num_rows
            if held >= PACKED:
                yield out()
        if held:
            yield out()
        trim()

    return answers.select("kind", "code", "block", "value").mapInArrow(run, "block long, kind int, codes binary, levels binary, places binary")


def unpack(codes: bytes, levels: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    steps, at = (np.ascontiguousarray(np.frombuffer(grow(x), np.uint8).reshape(size, -1).T).view(kind).ravel() for x, size, kind in ((codes, 8, np.int64), (places, 4, np.uint32)))
    return np.cumsum(steps), np.frombuffer(grow(levels), np.float64)[at]


def bundle(blocks: DataFrame, number: str) -> DataFrame:
    """(number, rows): some rows of a block together, compressed, as text takes several times the room in a shuffle."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for whole in batches:
            numbers = whole.column(number).to_numpy()
            for own in np.unique(numbers):
                where = np.flatnonzero(numbers == own)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=options) as stream:
                    stream.write_batch(whole.slice(where[0], len(where)))
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[number, "rows"])
        trim()

    return blocks.mapInArrow(run, T.StructType([T.StructField(number, T.LongType()), T.StructField("rows", T.BinaryType())]))


def unbundle(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_next_batch()


class _Answers:
    """Values by code. Pieces in order come in one after the other; they are kept by ranges of codes, each sorted by itself, so that sorting takes no room for all."""

    RANGES = 32

    def __init__(self):
        self.cuts, self.ranges, self.sorted = None, [], False

    def add(self, codes: np.ndarray, values: np.ndarray) -> None:
        if not len(codes):
            return
        if self.cuts is None:
            self.cuts = codes[np.arange(1, self.RANGES) * len(codes) // self.RANGES]
            self.ranges = [[] for _ in range(self.RANGES)]
        ends = [0, *np.searchsorted(codes, self.cuts).tolist(), len(codes)]
        for kept, a, b in zip(self.ranges, ends, ends[1:]):
            if b > a:
                kept.append((codes[a:b].copy(), values[a:b].copy()))

    def sort(self) -> None:
        for i, kept in enumerate(self.ranges):
            codes, values = (np.concatenate([np.empty(0, t), *(x[j] for x in kept)]) for j, t in enumerate((np.int64, np.float64)))
            kept.clear()
            order = np.argsort(codes, kind="stable")
            self.ranges[i] = codes[order], values[order]
            if i % 8 == 7:
                del codes, values, order
                trim()
        self.sorted = True

    def look(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is an answer for each code, and its value; wanted is in order."""
        if not self.sorted:
            self.sort()
        have, value = np.zeros(len(wanted), bool), np.zeros(len(wanted))
        if self.cuts is not None:
            ends = [0, *np.searchsorted(wanted, self.cuts).tolist(), len(wanted)]
            for (keys, values), a, b in zip(self.ranges, ends, ends[1:]):
                if b > a and len(keys):
                    at = np.minimum(np.searchsorted(keys, wanted[a:b]), len(keys) - 1)
                    have[a:b], value[a:b] = keys[at] == wanted[a:b], values[at]
        return have, value


class _Scores:
    """Scores of a block's rows. Answers are added first, then rows, which stay compressed until their block is at its end."""

    def __init__(self, text: str, mark: str, order: int):
        self.text, self.mark, self.order = text, mark, order
        self.known = {WORD: _Answers(), GRAM: _Answers()}
        self.rows, self.done, self.count = [], [], 0
        self.own = []  # words without an answer, and their rows

    def answer(self, kind: int, codes: bytes, levels: bytes, places: bytes) -> None:
        self.known[kind].add(*unpack(codes, levels, places))

    def add(self, rows: bytes) -> None:
        batch = unbundle(rows)
        m, column = batch.num_rows, batch.column(self.text)
        tokens, in_train, base, total = np.ones(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        for first, last, hashes, counted in textscan.segments(column, textscan.SPACED):
            row_of = np.repeat(np.arange(len(counted)), counted)
            distinct, at = np.unique(hashes.view(np.int64), return_inverse=True)  # look-ups in order are much faster
            have, value = (x[at] for x in self.known[WORD].look(distinct))
            tokens[first:last] += counted
            in_train[first:last] += np.bincount(row_of, have, len(counted)).astype(np.int64)
            base[first:last] += np.bincount(row_of, np.where(have, value, 0), len(counted))
            if not have.all():
                self.own.append((distinct[at[~have]], (self.count + first + row_of[~have]).astype(np.int32)))
        for first, wanted, counted in grams(column, self.order):
            distinct, at = np.unique(wanted, return_inverse=True)
            have, value = self.known[GRAM].look(distinct)
            if not have.all():
                raise ValueError("a gram of this block was not listed")
            total[first : first + len(counted)] += np.bincount(np.repeat(np.arange(len(counted)), counted), value[at], len(counted))
        self.rows.append(rows)
        self.done.append((batch.column(self.mark).to_numpy(zero_copy_only=False), tokens, in_train, base, total))
        self.count += m

    def out(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows as they came, with tokens, known tokens, sums of log10(c + 0.1) over tokens, and scores."""
        if not self.rows:
            return
        (end_known,), (end_value,) = self.known[WORD].look(np.array([END], np.int64))
        self.known.clear()
        trim()
        train, tokens, in_train, base, total = (np.concatenate(x) for x in zip(*self.done))
        if not end_known:
            end_known, end_value = train.any(), np.log10(train.sum() + 0.1)
        in_train += int(end_known)
        base += end_value
        if self.own:
            words, row_of = (np.concatenate(x) for x in zip(*self.own))
            self.own.clear()
            c, taught = np.zeros(len(words), np.int64), words[train[row_of]]
            if len(taught):
                taught, times = _counted(taught)
                at = np.minimum(np.searchsorted(taught, words), len(taught) - 1)
                c = np.where(taught[at] == words, times[at], 0)
            in_train += np.bincount(row_of, c > 0, self.count).astype(np.int64)
            base += np.bincount(row_of, np.log10(c + 0.1), self.count)
            del words, row_of, taught, c
        a = 0
        for rows in self.rows:
            batch = unbundle(rows)
            b = a + batch.num_rows
            yield batch, tokens[a:b], in_train[a:b], base[a:b], total[a:b]
            a = b


#: The columns that scoring adds.
RESULTS = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}


def score(docs: DataFrame, train: Column, *, text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with n_tokens, n_known, train_tokens, base_score and score last.

    The listing is dealt out by code once, so that counting and answering shuffle none of it.
    Tables are deleted once those made from them are written; the listing and the values stay,
    as the result is read from them.
    """
    small_bytes(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name.lower() not in RESULTS]
    mark, number = fresh(docs, "in_training"), fresh(docs, "block")
    marked = docs.withColumn(mark, F.coalesce(train, F.lit(False))).select(*(f.name for f in fields), mark)
    blocks = lay_down(marked, text, number, block_bytes)
    listed = settle_dealt(tally(blocks.select(F.col(number).alias("block"), F.col(mark).alias("train"), F.col(text).alias("text")), order), "lm-tally", ["kind", "code"], DELTAS)
    counts = settle(listed.groupBy("kind", "code").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")), "lm-counts")
    n, v = counts.where((F.col("kind") == WORD) & (F.col("c") > 0)).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where((F.col("kind") == WORD) & (F.col("c") > 0) & (F.col("blocks") > 1)).select("kind", "code", F.log10(F.col("c") + F.lit(0.1)).alias("value"))
    every = counts.where(F.col("kind") == GRAM)
    symbols, behind = gram_scores(every.select("code", "c"), order)
    values = settle(words.unionByName(symbols.select(F.lit(GRAM).alias("kind"), "code", "value")), "lm-values", DELTAS)
    forget(counts, *behind)
    answers = listed.select("kind", "code", "block").join(values.hint("merge"), ["kind", "code"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = float(np.log10(n + 0.1 * (v + 1))) if n or v else float(np.log10(0.1))
    schema = T.StructType([*fields, *(T.StructField(c, t) for c, t in RESULTS.items())])
    names = [f.name for f in fields]

    def run(batches):
        block, scores = None, _Scores(text, mark, order)

        def out():
            for batch, tokens, in_train, base, total in scores.out():
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(tokens), pa.array(in_train), pa.array(np.full(batch.num_rows, n)), pa.array(base - tokens * share), pa.array(total)], names=schema.names)

        for batch in batches:
            for i, (own, kind) in enumerate(zip(batch.column(number).to_pylist(), batch.column("kind").to_pylist())):
                if own != block:
                    yield from out()
                    block, scores = own, _Scores(text, mark, order)
                    trim()
                if kind == ROWS:
                    scores.add(batch.column("rows")[i].as_py())
                else:
                    scores.answer(kind, *(batch.column(c)[i].as_py() for c in ("codes", "levels", "places")))
        yield from out()
        scores = None
        trim()

    told = pack(answers).withColumnRenamed("block", number)
    asked = bundle(blocks, number).withColumn("kind", F.lit(ROWS))
    return told.unionByName(asked, allowMissingColumns=True).repartition(parts, number).sortWithinPartitions(number, "kind").mapInArrow(run, schema)
