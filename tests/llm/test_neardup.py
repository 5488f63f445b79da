import random

import numpy as np
import pytest

from stringloom.llm import neardup


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if i is not None and j is not None and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= 80 * (len(sets[x]) + len(sets[y]) - common):
                    a, b = sorted((top(i), top(j)))
                    label[b] = a
    return {i: (len(s), top(i) if i is not None else None) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "HOT", 24)
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    texts = [None, "", " \n", "one", "One", "one two", "two one"]
    for family in range(12):
        base = [word() for _ in range(rng.choice([3, 20, 120, 300]))]
        for _ in range(rng.choice([1, 2, 12, 40])):
            rate = rng.choice([0, 0.005, 0.02, 0.04, 0.06])
            texts.append(rng.choice([" ", "\n", "  "]).join(word() if rng.random() < rate else w.upper() if rng.random() < 0.1 else w for w in base))
    texts += texts[-3:] * 20
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t) for i, t in zip(ids, texts)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, texts[-1], 1)], "doc_id long, text string, kept int").repartition(3)
    got = neardup.groups(df, k=k).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows, k)
    wrong = [(r["doc_id"], r["component_id"], want[r["doc_id"]]) for r in got if r["doc_id"] is not None and (r["n_shingles"], r["component_id"]) != want[r["doc_id"]]]
    assert not wrong
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    kept = neardup.keep_one(df, k=k)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_and_null_ids(spark):
    """Rows are judged, not ids: B stays, one X stays, and one row of a group without ids."""
    a, b, x, y = ("red green blue grey pink gold", "one two three four five six seven", "sun moon star sky rain snow wind", "ash oak elm fir yew box bay")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, x, 4), (9, x, 4), (None, y, 5), (None, y, 5), (None, b, 6), (7, None, 8), (7, "", 9), (7, None, 8), (None, " ", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, judged_id int").repartition(3)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[3], rows[5], *rows[8:]]))
    got = sorted(map(repr, map(tuple, neardup.groups(df).collect())))
    want = [(3, 2, 3, True), (5, 2, 3, False), (5, 3, 5, True), (9, 3, 9, True), (9, 3, 9, True), (None, 3, None, True), (None, 3, None, True), (None, 3, 5, False), (7, 0, 7, True), (7, 0, 7, True), (7, 0, 7, True), (None, 0, None, True)]
    assert got == sorted(map(repr, want))


def test_sketches_keep_similar_pairs():
    """Pairs of a similarity of 0.8 are never ruled out; unrelated ones are."""
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 400, 5_000):
        for _ in range(200):
            both = np.unique(rng.integers(0, 2**63, 9 * n, dtype=np.uint64) * np.uint64(2))
            one, two = neardup.fine_sketch(both[np.arange(len(both)) % 9 != 0]), neardup.fine_sketch(both[np.arange(len(both)) % 9 != 4])
            filled = np.array([np.count_nonzero(two)])
            assert len(neardup.alike(one, 8 * n, two[None, :], filled, np.array([8 * n]), 77)) == 1
        other = neardup.fine_sketch(np.unique(rng.integers(0, 2**63, 9 * n, dtype=np.uint64) * np.uint64(2)))
        assert n < 5 or len(neardup.alike(one, 8 * n, other[None, :], np.array([np.count_nonzero(other)]), np.array([8 * n]), 80)) == 0


def test_no_links_and_empty(spark):
    few = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.groups(few).collect()) == [(1, 1), (2, 2)]
    assert neardup.groups(few.limit(0)).collect() == []
