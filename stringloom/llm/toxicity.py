"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

Words are runs of letters and digits with A-Z lower-cased. A word's embedding is the sum of
three rows of a hashed table. Filters of several widths run over the embeddings, are
rectified and max-pooled over the whole text, and a dense layer gives a logit. The network
is trained by stochastic gradients (Adagrad), in one task, on a bounded sample of labelled
documents, which reaches that task as word hashes only. A part of the sample is kept from
training: on it the epoch with the least loss and a threshold per language are chosen. The
language is guessed from the text, by counts of function words; the score is the logistic function of the logit less the threshold, so a
document is predicted toxic from a score of 0.5. Scoring reads whole texts, row by row,
without a shuffle.

Sample: per label the MAX_PER_LABEL documents with the smallest hash of doc_id; beyond that
bound more labelled rows don't change the model.

Defined cases: null and empty texts have no words and get the score of the bias; rows whose
label is null or repeated with other values are used as they are, the null ones not at all;
without labels of both kinds everything scores below 0.5; repeated documents get equal
scores; extra columns are kept.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .shared import fresh

MAX_PER_LABEL = {0: 4_500, 1: 1_500}
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 12, (1, 2, 3)
EPOCHS, BATCH, RATE, DROPOUT, SMOOTH = 6, 16, 0.06, 0.4, 0.04
WORDS_AT_ONCE = 1 << 16

#: Embeddings are trained for words of so many sampled documents at least, and such a share
#: of them: rarer words would only be learnt by heart.
MIN_DOCS, MIN_SHARE = 4, 0.004

#: A language with fewer toxic documents to calibrate on takes the threshold of all.
MIN_TOXIC = 15

#: Function words by which the language of a text is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in that is was with for as are be by on this not have from which",
    "de": "der die das und ist ein eine zu den mit nicht von im dem auf sich des auch als es",
    "fr": "le la les des et est un une du pour que dans qui pas au par sur ne se plus",
    "es": "el los las del que y en un una por con para no se su lo como al es más",
}
LANGUAGES = list(FUNCTION_WORDS)


def _word_hashes(words: str) -> np.ndarray:
    return np.concatenate([h for _, h in textscan.rows(pa.array([words]), textscan.ALNUM)])


_FUNCTION = [np.sort(_word_hashes(w)) for w in FUNCTION_WORDS.values()]


def language_counts(hashes: np.ndarray) -> np.ndarray:
    """For every language, 1 where a word is one of its function words."""
    out = np.zeros((len(_FUNCTION), len(hashes)), np.int32)
    for i, known in enumerate(_FUNCTION):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        out[i] = known[at] == hashes
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The three table rows of every word."""
    mask = np.uint64(BUCKETS - 1)
    return np.stack([(hashes >> np.uint64(shift)) & mask for shift in (0, 21, 42)]).astype(np.int32)


@dataclass
class Model:
    table: np.ndarray  # BUCKETS + 1 x DIM
    filters: list[np.ndarray]  # by width: width x DIM x FILTERS
    bias: list[np.ndarray]
    dense: np.ndarray
    constant: float
    thresholds: np.ndarray  # by language
    words: np.ndarray  # hashes of the words that were taught, in order

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The table rows of every word; a word that wasn't taught has the last row, which is zero."""
        known = np.zeros(len(hashes), bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
        return np.where(known, buckets(hashes), np.int32(BUCKETS))

    def __getstate__(self) -> dict:
        """Only the rows of the table that were taught are carried to the tasks."""
        taught = np.flatnonzero(self.table.any(axis=1))
        return self.__dict__ | {"table": (taught, self.table[taught])}

    def __setstate__(self, state: dict) -> None:
        taught, rows = state["table"]
        self.__dict__.update(state, table=np.zeros((BUCKETS + 1, DIM), np.float32))
        self.table[taught] = rows

    # -- the network, over documents laid end to end
    def pooled(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Pooled features (documents x filters) of word buckets (3 x words) and words per document."""
        out = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        gap = max(WIDTHS) - 1
        if rows.shape[1] > WORDS_AT_ONCE and len(full) == 1:  # one long text: in parts that overlap
            for a in range(0, rows.shape[1], WORDS_AT_ONCE):
                part = rows[:, a : a + WORDS_AT_ONCE + gap]
                out[full[0]] = np.maximum(out[full[0]], self._conv(part, np.array([part.shape[1]]), WORDS_AT_ONCE)[0])
            return out
        out[full] = self._conv(rows, counts[full])
        return out

    def _conv(self, rows: np.ndarray, counts: np.ndarray, starts: int | None = None) -> np.ndarray:
        """Pooled features; `starts` limits where windows of a single text start, as the rest follows."""
        gap = max(WIDTHS) - 1
        n, docs = rows.shape[1], len(counts)
        x = np.zeros((n + gap * docs, DIM), np.float32)
        where = np.arange(n) + gap * np.repeat(np.arange(docs), counts)
        x[where] = self.table[rows[0]] + self.table[rows[1]] + self.table[rows[2]]
        ends = np.cumsum(counts) + gap * np.arange(docs)
        borders = np.stack([ends - counts, ends if starts is None else np.minimum(ends, starts)], axis=1).ravel()
        borders[-1] = min(borders[-1], len(x) - gap)
        out = []
        for width, w, b in zip(WIDTHS, self.filters, self.bias):
            y = sum(x[j : len(x) - gap + j] @ w[j] for j in range(width))
            at = borders[:-1] if borders[-1] >= len(y) else borders
            out.append(np.maximum(np.maximum.reduceat(y, at, axis=0)[::2] + b, 0))
        return np.concatenate(out, axis=1)

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.dense + self.constant

    def score(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.logits(self.pooled(self.rows(hashes), counts)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds[languages(hashes, counts)], -40, 40)))


def languages(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The index of each document's language; the first one without any function word."""
    sums = np.concatenate([np.zeros((len(LANGUAGES), 1), np.int64), np.cumsum(language_counts(hashes), axis=1)], axis=1)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.argmax(sums[:, ends[1:]] - sums[:, ends[:-1]], axis=0)


# ------------------------------------------------------------------- training
class _Adagrad:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.squares = value, rate, np.full(value.shape, 1e-2, np.float32)

    def step(self, grad: np.ndarray) -> None:
        self.squares += grad * grad
        self.value -= self.rate * grad / np.sqrt(self.squares)

    def step_rows(self, rows: np.ndarray, grad: np.ndarray) -> None:
        own, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(own), grad.shape[1]), np.float32)
        np.add.at(total, at.ravel(), grad)
        self.squares[own] += total * total
        self.value[own] -= self.rate * total / np.sqrt(self.squares[own])


def train(samples: list[tuple[np.ndarray, int]], seed: int = 7) -> Model:
    """Fit the network to (word hashes, label) and calibrate it on every fifth sample."""
    rng = np.random.default_rng(seed)
    k = FILTERS
    model = Model(
        np.zeros((BUCKETS + 1, DIM), np.float32),  # words that are not taught say nothing
        [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, k)).astype(np.float32) for w in WIDTHS],
        [np.zeros(k, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, k * len(WIDTHS)).astype(np.float32),
        0.0,
        np.zeros(len(LANGUAGES)),
        np.empty(0, np.uint64),
    )
    labels = np.array([y for _, y in samples], np.int64)
    if len(set(labels.tolist())) < 2:
        model.dense[:], model.constant = 0, -1.0
        return model
    distinct = np.concatenate([np.unique(h) for h, _ in samples])
    words, held_by = np.unique(distinct, return_counts=True)
    words = model.words = words[held_by >= max(MIN_DOCS, MIN_SHARE * len(samples))]
    own = np.unique(buckets(words))
    model.table[own] = rng.normal(0, 0.1, (len(own), DIM))
    rows = [model.rows(h) for h, _ in samples]
    taught = [np.isin(h, words) for h, _ in samples]
    kept = np.arange(len(samples)) % 5 == 0
    kept &= len(samples) >= 50
    weight = np.where(labels == 1, (labels == 0).sum() / max(1, (labels == 1).sum()), 1.0).clip(0.1, 10)
    constant = np.zeros(1, np.float32)
    table, dense, const = _Adagrad(model.table, RATE), _Adagrad(model.dense, RATE), _Adagrad(constant, RATE)
    filters, bias = [_Adagrad(w, RATE / 2) for w in model.filters], [_Adagrad(b, RATE / 2) for b in model.bias]
    todo, held = np.flatnonzero(~kept), np.flatnonzero(kept)
    goal = np.where(labels == 1, 1 - SMOOTH, 0.0)
    best, best_loss = None, np.inf

    def held_logits() -> np.ndarray:
        model.constant = float(constant[0])
        return np.concatenate([model.logits(model.pooled(rows[i], np.array([rows[i].shape[1]]))) for i in held])

    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(todo), max(1, len(todo) // BATCH)):
            grads = [np.zeros_like(w) for w in model.filters]
            grad_bias = [np.zeros_like(b) for b in model.bias]
            grad_dense, grad_const = np.zeros_like(model.dense), np.zeros_like(constant)
            touched, pull = [], []
            for i in batch:
                r = rows[i]
                n = r.shape[1]
                if not n:
                    g = weight[i] * (1 / (1 + np.exp(-constant[0])) - goal[i])
                    grad_const += g
                    continue
                x = np.zeros((n + max(WIDTHS) - 1, DIM), np.float32)
                x[:n] = model.table[r].sum(axis=0)
                features, peaks = [], []
                for width, w, b in zip(WIDTHS, model.filters, model.bias):
                    y = sum(x[j : n + j] @ w[j] for j in range(width))
                    peak = y.argmax(axis=0)
                    peaks.append(peak)
                    features.append(np.maximum(y[peak, np.arange(k)] + b, 0))
                f = np.concatenate(features) * ((rng.random(len(model.dense)) >= DROPOUT) / np.float32(1 - DROPOUT)).astype(np.float32)
                z = float(np.clip(f @ model.dense + constant[0], -30, 30))
                g = np.float32(weight[i] * (1 / (1 + np.exp(-z)) - goal[i]))
                grad_dense += g * f
                grad_const += g
                back = g * model.dense * (f > 0) / np.float32(1 - DROPOUT)
                for a, (width, w, peak) in enumerate(zip(WIDTHS, model.filters, peaks)):
                    own = back[a * k : (a + 1) * k]
                    live = np.flatnonzero(own)
                    grad_bias[a] += own
                    for j in range(width):
                        at = peak[live] + j
                        grads[a][j][:, live] += x[at].T * own[live]
                        inside = at < n
                        inside[inside] = taught[i][at[inside]]
                        into = (w[j][:, live] * own[live]).T[inside]
                        for side in range(len(r)):
                            touched.append(r[side, at[inside]])
                            pull.append(into)
            for o, g in [*zip(filters, grads), *zip(bias, grad_bias), (dense, grad_dense), (const, grad_const)]:
                o.step(g / len(batch))
            if touched:
                table.step_rows(np.concatenate(touched), np.concatenate(pull) / len(batch))
        if len(held):  # keep the epoch with the least loss on the documents kept from training
            z = np.clip(held_logits(), -30, 30)
            loss = float((weight[held] * np.log1p(np.exp(np.where(labels[held] == 1, -z, z)))).sum())
            if loss < best_loss:
                best_loss, best = loss, [a.copy() for a in (model.table, *model.filters, *model.bias, model.dense, constant)]
    if best:
        for a, b in zip((model.table, *model.filters, *model.bias, model.dense, constant), best):
            a[...] = b
    model.constant = float(constant[0])
    if len(held):
        z = held_logits()
        lang = np.concatenate([languages(samples[i][0], np.array([len(samples[i][0])])) for i in held])
        everything = _threshold(z, labels[held], 0.0)
        for code in range(len(LANGUAGES)):
            own = lang == code
            model.thresholds[code] = _threshold(z[own], labels[held][own], everything) if labels[held][own].sum() >= MIN_TOXIC else everything
    return model


def _threshold(z: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    """The middle of the widest gap between logits that gives the best F1; `otherwise` without both labels."""
    if len(set(y.tolist())) < 2:
        return otherwise
    order = np.argsort(-z)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low = np.append(z[order], z.min() - 1)
    gaps = low[best] - low[best + 1]
    i = best[np.argmax(gaps)]
    return float((low[i] + low[i + 1]) / 2)


# ------------------------------------------------------------------- the jobs
def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_per_label: dict[int, int] | None = None) -> Model:
    """A model from the labelled documents; both sides are joined on doc_id."""
    own = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    few = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit((max_per_label or MAX_PER_LABEL)[y]) for y in (0, 1)]
    chosen = few[0].unionByName(few[1])  # as many rows as the bounds, at most
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches):
        for batch in batches:
            for i, h in textscan.rows(batch.column("_text"), textscan.ALNUM):
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, 1), batch.column("_y").slice(i, 1), pa.array([h.tobytes()], pa.binary())], names=["_id", "_y", "h"])

    def learn(batches):
        got = [x for batch in batches for x in zip(batch.column("_id").to_pylist(), batch.column("_y").to_pylist(), batch.column("h").to_pylist())]
        got.sort(key=lambda x: (repr(x[0]), x[1], x[2]))
        model = train([(np.frombuffer(h, np.uint64), y) for _, y, h in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    kind = found.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_y", T.IntegerType()), T.StructField("h", T.BinaryType())])
    sample = found.select("_id", "_y", "_text").mapInArrow(run, schema)
    trained = sample.repartition(1).mapInArrow(learn, "model binary").collect()  # one task for the bounded sample, so the driver's memory is spared
    return pickle.loads(trained[0]["model"]) if trained else train([])


def score(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """The rows with the score (0 to 1, toxic from 0.5) last."""

    kept = [f for f in docs.schema.fields if f.name.lower() != column.lower()]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, last, hashes, counts in textscan.segments(batch.column(text), textscan.ALNUM):
                out[first:last] = model.score(hashes, counts)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(out)], names=schema.names)

    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, **kw) -> DataFrame:
    """Only the documents that are not predicted toxic, as they were."""
    column = fresh(docs, "toxic_score")
    return score(docs, model, column=column, **kw).where(F.col(column) < 0.5).select(*docs.columns)
