"""The suffix order of a collection against brute force, over partitions smaller than its common keys."""

import random
from itertools import groupby
from pathlib import Path

import pytest

from stringloom.operators import corpus, ranges
from stringloom.session import shared_path


@pytest.mark.parametrize("rows,width", [(17, 2), (2_000_000, 32)])
def test_order_lcp_and_runs(spark, monkeypatch, rows, width):
    monkeypatch.setattr(corpus, "ROWS", rows)
    rng = random.Random(2)
    long = "the same long line of words once more, é. " * 3
    texts = [long, "x" + long, long, "a" * 60, "a" * 30, "", None, "日本", "banana", "ab" * 20] + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 25))) for _ in range(6)]
    frame = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "text_id long, text string")
    want = sorted((t[p:], 10 - i, p, t[p - 1] if p else None) for i, t in enumerate(texts) for p in range(len(t or "")))
    ordered = corpus.suffixes(frame, width=width).cache()
    got = sorted(tuple(r) for r in ordered.collect())
    assert [(r[1], r[2]) for r in got] == [(w[1], w[2]) for w in want] and [r[0] for r in got] == list(range(len(want)))
    assert [r[4] for r in got] == [w[3] for w in want]
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [r[3] for r in got] == [0] + [common(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]
    runs = [k for k, _ in groupby(w[3] for w in want)]
    assert {(r["ch"], r["runs"], r["length"]) for r in corpus.runs(ordered).collect()} == {(c, runs.count(c), [w[3] for w in want].count(c)) for c in set(runs)}
    ordered.unpersist()
    if width == 2:
        assert sorted(tuple(r) for r in corpus.suffix_order(frame, width=4).collect()) == [r[:3] for r in got]
        assert corpus.suffix_order(frame.where("text_id > 99")).collect() == []


def test_ranks_leave_one_table(spark):
    """Ranks across partitions, nulls alike; what they were made from is deleted, and no window shuffles the rows again."""
    rows = [(k, i) for i, k in enumerate(["b", None, "a", "b", None, "c", "a", "b"] * 5)]
    frame = spark.createDataFrame(rows, "k string, i long").repartition(3)
    folder = Path(shared_path(spark, "any").replace("file:", "")).parent
    before = set(folder.glob("ranks-*"))
    got = corpus.global_ranks(frame, ["k", "i"], {"r": ["k"], "u": ["k", "i"]}, ["i"])
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    keys = [w[0] for w in want]
    assert sorted(map(tuple, got.select("i", "r", "u").collect())) == sorted((i, keys.index(k), u) for u, (k, i) in enumerate(want))
    assert Path(got._settled_at.replace("file:", "")).exists() and set(folder.glob("ranks-*")) == before
    assert "Window" not in corpus._ranked(frame, ["k", "i"], {"r": ["k"]})._jdf.queryExecution().executedPlan().toString()


def test_ranges_and_ties_by_pieces(spark, monkeypatch):
    """Suffixes are dealt out packed and told apart by pieces; no table of all positions but the sorted one is written."""
    monkeypatch.setattr(corpus, "ROWS", 60)
    monkeypatch.setattr(ranges, "VOLUME", 100)
    rng = random.Random(5)
    letters = ["a", "b", "é", "日", "😀", "\0", " "]
    long = "".join(rng.choice(letters) for _ in range(700))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(25)] + [long, long[150:400] + "x", "", None, "a", "a\0", "é"]
    frame = spark.createDataFrame([(7 * i - 50, t) for i, t in enumerate(texts)], "text_id long, text string").repartition(3)
    folder = Path(shared_path(spark, "any").replace("file:", "")).parent
    before = set(folder.glob("*"))
    ordered = corpus.suffixes(frame, width=16)
    got = sorted(map(tuple, ordered.collect()))
    assert {p.name.split("-")[0] for p in set(folder.glob("*")) - before} <= {"suffixes", "tied", "told"}
    want = sorted((t[p:], 7 * i - 50, p, t[p - 1] if p else None) for i, t in enumerate(texts) for p in range(len(t or "")))
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    lcps = [0] + [common(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]
    assert max(lcps) > 200
    assert got == [(r, w[1], w[2], n, w[3]) for r, (w, n) in enumerate(zip(want, lcps, strict=True))]
    runs = [k for k, _ in groupby(w[3] for w in want)]
    assert {tuple(r) for r in corpus.runs(ordered.repartition(5)).collect()} == {(c, runs.count(c), [w[3] for w in want].count(c)) for c in set(runs)}
    assert [f.dataType.simpleString() for f in ordered.schema] == ["bigint", "bigint", "int", "int", "string"]


def test_runs_write_ends_of_stretches_only(spark):
    """No table of all ranks is written or shuffled, in whatever order the rows come."""
    rng = random.Random(8)
    letters = [rng.choice(["a", "b", None]) for _ in range(900)]
    frame = spark.createDataFrame(list(enumerate(letters)), "rank long, bwt string").repartitionByRange(3, "rank")
    folder = Path(shared_path(spark, "any").replace("file:", "")).parent
    before = set(folder.glob("*"))
    got = {tuple(r) for r in corpus.runs(frame).collect()}
    runs = [k for k, _ in groupby(letters)]
    assert got == {(c, runs.count(c), letters.count(c)) for c in ("a", "b", None)}
    (made,) = set(folder.glob("*")) - before
    assert spark.read.parquet(str(made)).count() < 50
    assert {tuple(r) for r in corpus.runs(frame.orderBy(frame.rank % 7)).collect()} == got
