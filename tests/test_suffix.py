import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stringloom.operators import sorting, suffix, suffixient
from stringloom.session import settle_rows

PAPER = "AATAATATGATAATAAAGA"
TEXTS = [PAPER, "A", "aaaa", "ACGT", "banana", "abracadabra", PAPER * 2, "ab" * 200 + "c" + "ab" * 150, "", None] + [
    "".join(random.Random(i).choice("ab" if i % 2 else "abcé") for _ in range(1 + i * 3 % 60)) for i in range(40)
]


def supermaximal(t):
    follow = defaultdict(set)
    for i in range(len(t) + 1):
        for j in range(i, len(t) + 1):
            follow[t[i:j]].add(t[j : j + 1])
    e = {a + c for a, cs in follow.items() if len(cs) > 1 for c in cs if c}
    return sorted(x for x in e if not any(y != x and y.endswith(x) for y in e))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "text_id long, text string")


@pytest.mark.parametrize("width", [1, 4, 32])
def test_suffixes_brute_force(texts, width):
    got = defaultdict(list)
    for r in suffix.suffixes(texts, width=width).orderBy("text_id", "rank").collect():
        got[r["text_id"]].append(r)
    for i, t in enumerate(TEXTS):
        if not t:
            assert i not in got
            continue
        order = sorted(range(len(t) + 1), key=lambda p: t[p:])
        assert [r["sa"] for r in got[i]] == order
        assert [r["rank"] for r in got[i]] == list(range(len(t) + 1))
        assert [r["bwt"] for r in got[i]] == [t[p - 1] if p else None for p in order]
        for r, p, q in zip(got[i][1:], order, order[1:]):
            n = 0
            while p + n < len(t) and q + n < len(t) and t[p + n] == t[q + n]:
                n += 1
            assert r["lcp"] == n


def test_paper_golden(texts):
    rows = suffix.suffixes(suffix.reversed_texts(texts)).where("text_id = 0").orderBy("rank").collect()
    assert [r["sa"] for r in rows] == [19, 18, 17, 2, 14, 3, 6, 0, 9, 15, 12, 4, 7, 1, 10, 16, 13, 5, 8, 11]
    assert [r["lcp"] for r in rows] == [0, 0, 1, 2, 2, 5, 4, 1, 2, 1, 4, 6, 3, 0, 1, 0, 3, 5, 2, 2]
    assert "".join(r["bwt"] or "$" for r in rows) == "AATGTAT$TATAAAAAAAAG"
    ordered = suffix.suffixes(suffix.reversed_texts(texts))
    assert suffix.run_counts(ordered).where("text_id = 0").first()["runs"] == 12
    ends = suffix.prefix_array(ordered).where("text_id = 0").orderBy("rank").collect()
    assert [r["end"] + 1 for r in ends] == [1, 2, 17, 5, 16, 13, 19, 10, 4, 7, 15, 12, 18, 9, 3, 6, 14, 11, 8]


def test_suffixient_sets(texts):
    chosen = suffixient.suffixient_set(texts)
    got, at = defaultdict(list), defaultdict(list)
    for r in suffixient.extensions(chosen, texts).collect():
        got[r["text_id"]].append(r["extension"])
    for r in chosen.collect():
        at[r["text_id"]].append(r["pos"] + 1)
    for i, t in enumerate(TEXTS):
        if t and len(t) < 100:
            assert sorted(got[i]) == supermaximal(t)
    assert sorted(at[0]) == [6, 8, 9, 11, 12, 16, 17, 18]
    assert [sorted(at[i]) for i in range(1, 7)] == [[1], [4], [1, 2, 3, 4], [1, 2, 5], [1, 2, 3, 5, 7], [9, 11, 16, 17, 18, 20, 22, 25, 27, 31]]
    counts = {r["ch"]: (r["n"], r["first"]) for r in suffixient.multiplicities(chosen).where("text_id = 0").collect()}
    assert counts == {"A": (3, 0), "G": (2, 3), "T": (3, 5)}
    ordered = suffixient.index(chosen).where("text_id = 0").orderBy("ord").collect()
    assert [r["pos"] for r in ordered] == [16, 15, 11, 17, 8, 5, 10, 7]


def test_neighbours_golden(texts):
    rows = suffixient.neighbours(suffixient.suffixient_set(texts), texts).where("text_id = 0").orderBy("ch", "rank").collect()
    assert [r["lcs"] for r in rows] == [0, 2, 1, 0, 1, 0, 2, 2]
    assert {r["pos"] + 1: r["len"] for r in rows} == {17: 2, 6: 2, 18: 1, 11: 2, 16: 2, 8: 2, 12: 1, 9: 1}


def test_algorithm_names(texts):
    with pytest.raises(ValueError):
        suffixient.suffixient_set(texts, algorithm="other")
    some = texts.where("text_id < 6")
    assert {suffixient.suffixient_set(some, algorithm=a).count() for a in suffixient.ALGORITHMS} == {22}


def test_kmer_contexts(texts):
    chosen = suffixient.suffixient_set(texts)
    got = {k: suffixient.kmer_contexts(chosen, texts, k=k).where("text_id = 0").first()[1:] for k in (2, 3, 4)}
    assert got == {2: (5, 3), 3: (8, 1), 4: (8, 1)}


def test_sets_are_made_where_texts_are_sorted(texts, monkeypatch):
    """Nothing but the texts is shuffled for a set, and the way by windows, for longer texts, gives the same rows."""
    chosen = suffixient.suffixient_set(texts)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1
    want = sorted(map(tuple, chosen.collect()))
    ordered = settle_rows(suffix.suffixes(suffix.reversed_texts(texts)), "suffixes")
    assert sorted(map(tuple, suffixient.from_suffixes(ordered).collect())) == want
    monkeypatch.setattr(suffix, "LONG", 20)
    assert sorted(map(tuple, suffixient.suffixient_set(texts).collect())) == want


def test_no_texts(spark):
    none = spark.createDataFrame([], "text_id long, text string")
    assert suffix.suffixes(none).collect() == []
    assert suffixient.suffixient_set(none).collect() == []


def test_range_minima(spark):
    values = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, 3, 9, 1, 7])], "text_id long, rank int, v int")
    got = {(r["level"], r["rank"]): r["least"] for r in suffix.range_minima(values, F.col("v"), 4).collect()}
    assert got[(0, 2)] == 9 and got[(1, 0)] == 3 and got[(2, 1)] == 1 and (2, 2) not in got


def test_long_texts_are_joined_and_runs_made_where_sorted(texts, monkeypatch):
    """Texts beyond LONG take the way by joins; both ways give the same rows, and bwt_runs the runs of them."""
    want = sorted(map(tuple, suffix.suffixes(texts).collect()))
    runs = sorted(map(tuple, suffix.runs(suffix.suffixes(texts)).collect()))
    assert sorted(map(tuple, suffix.bwt_runs(texts).collect())) == runs
    monkeypatch.setattr(suffix, "LONG", 20)
    assert sorted(map(tuple, suffix.suffixes(texts).collect())) == want
    assert sorted(map(tuple, suffix.bwt_runs(texts).collect())) == runs


def test_suffix_rows_are_not_sent_to_all(spark, texts):
    """A sorted text's rows are neither shuffled by windows nor joined; a table of them is never broadcast, however small its file."""
    plan = suffix.suffixes(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    settled = settle_rows(suffix.suffixes(texts), "suffixes")
    plan = settled.join(texts, "text_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("step", [1, 50, 1 << 20])
def test_sorted_in_batches(texts, monkeypatch, step):
    monkeypatch.setattr(sorting, "STEP", step)
    held = [t for t in TEXTS if t]
    got = [(first + r, k, p) for first, some in sorting.chunks(held) for s in [sorting.sort(some, 32)] for r, k, p in zip(s.row.tolist(), s.rank.tolist(), s.sa.tolist())]
    assert got == [(i, k, p) for i, t in enumerate(held) for k, p in enumerate(sorted(range(len(t) + 1), key=lambda p: t[p:]))]
