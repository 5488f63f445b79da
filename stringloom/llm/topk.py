"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Index: the vectors are packed into blocks. In a block every non-zero component is a posting
(dimension, vector, value); postings lie in segments by descending quantised impact, that
is |value| // STEP (neighbouring levels with few postings share a segment), and in a segment
in one list per dimension, ordered by vector. For every segment's end the block also keeps,
per vector, the length (2-norm) of the components still to come. Postings are worked out
once and written with the vectors to the shared folder; searches read them from there.

Search: a query adds up one segment after another, from the lists of its own dimensions. After
each, a vector's score is known to within the query's length times the vector's remaining
length (Cauchy-Schwarz), so every vector whose upper bound is below the k-th best lower bound
is out, by proof. Once few vectors are left, or the segments end, those left are scored
exactly in 64-bit integers.
Every block gives its k best, the k best of those are the answer.

Every query block meets every index block. Query blocks are broadcast, once for all index blocks,
while they are small; else tasks take pairs of partitions of both, and the driver gets neither.

Defined cases: vectors that are null or hold null or non-finite components, and rows without
an id, take no part; shorter vectors count as followed by zeros; an id that is repeated asks
once, with its smallest vector, and answers with every row; ties go to the smaller id; with
fewer than k candidates all are returned; other columns are ignored. Scores have to stay
within 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, small_bytes

#: Vectors of an index block, queries of a query block, width of an impact level.
BLOCK, QUERIES, STEP = 4096, 512, 16

#: Levels that begin in the same share of the block's postings share a segment.
SHARE = 0.15

#: Bytes of query blocks up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def quantise(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, or null for a vector that takes no part."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & whole, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(counts.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < counts[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest signed type that holds them all."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)).tobytes()


def _numbers(data: bytes, *shape: int) -> np.ndarray:
    """The numbers of _bytes, as 64-bit."""
    size = int(np.prod(shape))
    return np.frombuffer(data, f"i{len(data) // size}" if size else np.int8).reshape(shape).astype(np.int64)


def _pack(vectors: DataFrame, size: int, more: str = "", extra=None) -> DataFrame:
    """(part, number, n, width, ids, vectors): blocks of up to `size` vectors of each partition, as bytes.

    `extra` gives the columns named in the schema `more` from a block's matrix.
    """
    names = ["part", "number", "n", "width", "ids", "vectors", *(c.split()[0] for c in more.split(",") if c)]

    def run(batches):
        from pyspark import TaskContext

        part, number, wait = TaskContext.get().partitionId(), 0, []

        def out():
            nonlocal number, wait
            table = pa.Table.from_batches(wait).combine_chunks()
            ids, values = table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks())
            number, wait = number + 1, []
            row = [part, number, *values.shape, ids.astype(np.int64).tobytes(), _bytes(values), *(extra(values) if extra else ())]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], names=names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = size - sum(b.num_rows for b in wait)
                wait.append(batch.slice(at, room))
                at += room
                if sum(b.num_rows for b in wait) >= size:
                    yield out()
        if wait:
            yield out()

    return vectors.select("vec_id", "v").mapInArrow(run, "part long, number long, n long, width long, ids binary, vectors binary" + more)


#: What a block's postings are stored as.
POSTINGS = ", segments long, total long, lists binary, owners binary, impacts binary, rest binary"


def postings(values: np.ndarray) -> tuple[int, int, bytes, bytes, bytes, bytes]:
    """Of a block: segments, postings, postings by segment and dimension, each one's vector and value, lengths to come."""
    n, width = values.shape
    owner, dimension = np.nonzero(values)
    value = values[owner, dimension]
    levels, level, counts = np.unique(-(np.abs(value) // STEP), return_inverse=True, return_counts=True)  # highest first
    begins = np.cumsum(counts) - counts
    shares, segment_of = np.unique((begins / (SHARE * max(1, len(value)))).astype(np.int64), return_inverse=True)
    segment, segments = segment_of[level], len(shares)
    order = np.lexsort((owner, dimension, segment))
    lists = np.bincount(segment * width + dimension, minlength=segments * width)
    squares = np.bincount(segment * n + owner, value.astype(np.float64) ** 2, segments * n).reshape(segments, n)
    after = np.vstack([squares[1:], np.zeros((min(1, segments), n))])
    rest = np.sqrt(np.cumsum(after[::-1], axis=0)[::-1])
    return segments, len(value), _bytes(lists), _bytes(owner[order]), _bytes(value[order]), rest.tobytes()


class Index:
    """The stored postings of one block, read back."""

    def __init__(self, row: dict):
        n, width, segments, total = (row[c] for c in ("n", "width", "segments", "total"))
        self.ids, self.values = np.frombuffer(row["ids"], np.int64), _numbers(row["vectors"], n, width)
        self.lists = _numbers(row["lists"], segments, width)
        self.owners, self.impacts = _numbers(row["owners"], total), _numbers(row["impacts"], total).astype(np.float64)
        self.rest = np.frombuffer(row["rest"]).reshape(segments, n)
        self.longest = float(np.sqrt((self.values.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))

    def possible(self, asked: int, query: np.ndarray, length: float, k: int) -> np.ndarray:
        """Places of the vectors that may be among the k best."""
        n = len(self.ids)
        left, score, at = self.ids != asked, np.zeros(n), 0
        for lists, rest in zip(self.lists, self.rest) if n > k else []:
            weights, owners, impacts = np.repeat(query, lists), self.owners[at : at + lists.sum()], self.impacts[at : at + lists.sum()]
            at += len(weights)
            if not query.all():
                used = weights != 0
                weights, owners, impacts = weights[used], owners[used], impacts[used]
            score += np.bincount(owners, weights * impacts, n)
            slack = rest * length + 1e-6
            low = np.where(left, score - slack, -np.inf)
            left &= score + slack >= np.partition(low, n - k)[n - k]
            if np.count_nonzero(left) <= max(4 * k, n // 32):
                break
        return np.flatnonzero(left)

    def search(self, asked: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query, ids and exact scores of the k best vectors but its own."""
        q = np.zeros((len(asked), self.values.shape[1]), np.int64)
        q[:, : queries.shape[1]] = queries[:, : q.shape[1]]
        weights = q.astype(np.float64)
        lengths = np.sqrt((weights**2).sum(axis=1)) * (1 + 1e-9)
        if lengths.max(initial=0) * self.longest >= 2.0**53:
            raise ValueError("scores may exceed 2**53: use a smaller scale")
        out = []
        for i in range(len(asked)):
            left = self.possible(asked[i], weights[i], lengths[i], k)
            exact = self.values[left] @ q[i]
            best = np.lexsort((self.ids[left], -exact))[:k]
            out.append((self.ids[left][best], exact[best]))
        return out


def search(vectors: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows; rank from 1."""
    small_bytes(vectors.sparkSession)  # each row holds an index block
    valid = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantise(F.col(embedding), scale).alias("v"), is_query.alias("_asks")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    index = settle(_pack(valid, block, POSTINGS, postings), "vector-blocks")
    asking = valid.where("_asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = settle(_pack(asking, QUERIES), "query-blocks")
    volume = asked.agg(F.sum(F.length("ids") + F.length("vectors"))).first()[0] or 0
    queries = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "vectors")))
    # told how, as a file's size says little about the rows that Spark would bring to the driver
    pairs = index.crossJoin(queries.hint("broadcast" if volume <= BROADCAST_BYTES else "shuffle_replicate_nl"))

    columns = index.columns

    def run(batches):
        key = own = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("part", "number", "q_n", "q_width", "q_ids", "q_vectors")}
                if key != (row["part"], row["number"]):
                    key = row["part"], row["number"]
                    own = Index({c: batch.column(c)[i].as_py() for c in columns})
                queries = _numbers(row["q_vectors"], row["q_n"], row["q_width"])
                asked_ids = np.frombuffer(row["q_ids"], np.int64)
                found = own.search(asked_ids, queries, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked_ids, [len(x[0]) for x in found])), pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
