import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.llm import textscan, toxicity

BAD = ["vile", "scorn", "filth", "wretch", "dolt"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghimnoprst") for _ in range(rng.randint(2, 8))) for _ in range(400)] + "the of and to in".split()
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w).capitalize() + ".", int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(10_000, None, "x"), (10_001, "", "x"), (0, rows[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(5000, None), (5001, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] < 900 and r["doc_id"] % 3 == 0]
    assert np.mean(held) > 0.97
    clean = toxicity.reject(docs, model)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in got if r["score"] < 0.5}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_one_label_only(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("score") >= 0.5).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where(F.col("score") >= 0.5).count() == 0


def test_batches_and_long_texts_agree(monkeypatch):
    rows = corpus(60)
    hashes = dict(textscan.rows(pa.array([t for _, t, _ in rows]), textscan.ALNUM))
    model = toxicity.train([(hashes[i], y) for i, _, y in rows])
    texts = [rows[0][1], "", rows[1][1], " ".join(t for _, t, _ in rows), "a"]
    column = pa.array([None, *texts])
    whole = np.full(len(column), -1.0)
    for a, b, h, c in textscan.segments(column, textscan.ALNUM):
        whole[a:b] = model.score(h, c)
    single = [float(model.score(h, np.array([len(h)]))[0]) for _, h in textscan.rows(column, textscan.ALNUM)]
    assert np.allclose(whole, single, atol=1e-5)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 50)
    parts = [float(model.score(h, np.array([len(h)]))[0]) for _, h in textscan.rows(column, textscan.ALNUM)]
    assert np.allclose(parts, single, atol=1e-5)


def test_words_in_segments(monkeypatch):
    texts = ["", "one Two", None, "three  four\n" * 40, "x" * 500, "ünï cödé"]
    want = {i: len(h) for i, h in textscan.rows(pa.array(texts), textscan.SPACED)}
    hashes = [h for _, h in textscan.rows(pa.array(texts), textscan.SPACED)]
    assert want == {0: 0, 1: 2, 2: 0, 3: 80, 4: 1, 5: 2}
    monkeypatch.setattr(textscan, "SEGMENT", 16)
    for a, (_, b) in zip(hashes, textscan.rows(pa.array(texts), textscan.SPACED)):
        assert (a == b).all()
    (_, x), (_, y) = textscan.rows(pa.array(["The END", "the end"]), textscan.SPACED)
    assert (x == y).all()


def test_scores_equal_a_plain_forward_pass():
    """Windows one by one, in plain loops; words that weren't taught add nothing, whatever their buckets hold."""
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(0, 2**63, 300, dtype=np.uint64)
    docs = [(rng.choice(vocabulary[:150] if y else vocabulary[100:250], 30), y) for y in (0, 1) for _ in range(60)]
    model = toxicity.train(docs)
    taught = set(model.words.tolist())
    texts = [rng.choice(vocabulary, n) for n in (0, 1, 2, 3, 50)] + [np.array([int(model.words[0]), 1], np.uint64)]
    assert not all(int(h) in taught for t in texts for h in t)
    got = model.score(np.concatenate(texts), np.array([len(t) for t in texts]))
    for t, score in zip(texts, got):
        rows = toxicity.buckets(t)
        x = [model.table[rows[:, i]].sum(axis=0) if int(t[i]) in taught else np.zeros(toxicity.DIM) for i in range(len(t))] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
        features = []
        for width, w, b in zip(toxicity.WIDTHS, model.filters, model.bias):
            for f in range(toxicity.FILTERS):
                best = max((sum(float(x[i + j] @ w[j][:, f]) for j in range(width)) + float(b[f]) for i in range(len(t))), default=0.0)
                features.append(max(0.0, best))
        z = float(np.dot(features, model.dense)) + model.constant - model.thresholds[toxicity.languages(t, np.array([len(t)]))[0]]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_result_name_in_another_case(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, Score string")
    assert toxicity.score(df, toxicity.train([])).select("score").first()[0] < 1
