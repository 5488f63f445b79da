import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.llm import topk


def brute(rows, k, asks):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in vectors:
        if asks(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


@pytest.mark.parametrize("dims,n,block", [(8, 300, 32), (64, 200, 4096), (1, 50, 7), (5, 4, 4096)])
def test_matches_brute_force(spark, dims, n, block):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(10)] + [(2000, None), (2010, [float("nan")] * dims), (2020, [None] * dims), (2030, [float("inf")] * dims), (None, [1.0] * dims), (2040, [0.0] * dims), (2050, []), (2060, [0.5] * (dims + 2))]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 10 == 0, 5, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 5, lambda i: i % 10 == 0)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_scores_too_large(spark):
    df = spark.createDataFrame([(i, [1e6] * 4) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*53"):
        topk.search(df, F.col("vec_id") % 10 == 0, 5, scale=1 << 20).collect()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("vec_id") % 10 == 0, 5).collect() == []


def test_postings_by_descending_impact():
    rng = np.random.default_rng(3)
    values = np.where(rng.random((200, 40)) < 0.3, rng.integers(-900, 900, (200, 40)), 0)
    segments, total, lists, owners, impacts, rest = topk.postings(values)
    row = {"n": 200, "width": 40, "ids": np.arange(200).tobytes(), "vectors": topk._bytes(values), "segments": segments, "total": total, "lists": lists, "owners": owners, "impacts": impacts, "rest": rest}
    index = topk.Index(row)
    assert segments > 3 and (index.values == values).all() and index.lists.shape == (segments, 40)
    back, least, at = np.zeros_like(values), None, 0
    for s in range(segments):
        levels = []
        for d in range(40):
            part = slice(at, at + index.lists[s, d])
            at += index.lists[s, d]
            assert (np.diff(index.owners[part]) > 0).all()
            back[index.owners[part], d] += index.impacts[part].astype(np.int64)
            levels += (np.abs(index.impacts[part]) // topk.STEP).tolist()
        assert least is None or max(levels) < least
        least = min(levels)
        assert np.allclose(index.rest[s], np.sqrt(((values - back) ** 2).sum(axis=1)))
    assert at == total and (back == values).all()


def test_stops_on_proof_only():
    rng = np.random.default_rng(4)
    values = np.where(rng.random((500, 30)) < 0.1, rng.integers(-2000, 2000, (500, 30)), rng.integers(-3, 3, (500, 30)))
    segments, total, lists, owners, impacts, rest = topk.postings(values)
    index = topk.Index({"n": 500, "width": 30, "ids": np.arange(500).tobytes(), "vectors": topk._bytes(values), "segments": segments, "total": total, "lists": lists, "owners": owners, "impacts": impacts, "rest": rest})
    some = np.arange(0, 500, 7)
    left = 0
    for q, (ids, scores) in zip(some, index.search(some, values[some], 5)):
        exact = values @ values[q]
        want = sorted((-exact[j], j) for j in range(500) if j != q)[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == want
        weights = values[q].astype(float)
        left += len(index.possible(q, weights, float(np.sqrt((weights**2).sum())) * (1 + 1e-9), 5))
    assert left < 20 * 5 * len(some)


def test_many_queries_stay_off_the_driver(spark, monkeypatch):
    """Query blocks beyond the bound are not broadcast, nor are copies of them; answers are the same."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute(rows, 5, lambda i: i % 2 == 0)
    for most in (topk.BROADCAST_BYTES, 0):
        monkeypatch.setattr(topk, "BROADCAST_BYTES", most)
        found = topk.search(df, F.col("vec_id") % 2 == 0, 5, block=16)
        got = {}
        for r in sorted(found.collect()):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Broadcast" in plan) == (most > 0) and "Generate" not in plan
