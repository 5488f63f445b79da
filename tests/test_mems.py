"""Maximal matches of patterns in whole texts, against brute force; the registered queries meet real matches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stringloom.operators import matching, search
from stringloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", [1, 4, 16])
def test_mems_and_longest_prefix_in_texts(spark, monkeypatch, seed):
    monkeypatch.setattr(matching, "BLOCK", 100 if seed == 4 else 200_000)
    monkeypatch.setattr(matching, "STEP", 50 if seed == 16 else 1 << 17)
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.choice([1, 40, 600]))) for _ in range(12)] + ["", None, "ab" * 40]
    patterns = ["ab", "zz", "z", "", None, "ab" * 50, texts[2] + "z" + texts[3][-30:], texts[4][:70] + texts[5][:5]] + ["".join(rng.choice("abcéz ") for _ in range(rng.randint(1, 60))) for _ in range(12)]
    p, t = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, seq string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")

    def place(q):
        return next(((i, x.find(q)) for i, x in enumerate(texts) if x and q in x), (None, -1)) if q else (None, -1)

    want, ends = set(), {}
    for j, q in enumerate(patterns):
        if q is None:
            continue
        ms = [max(k for k in range(len(q) - i + 1) if not k or place(q[i : i + k])[1] >= 0) for i in range(len(q))]
        want |= {(j, i, n, *place(q[i : i + n])) for i, n in enumerate(ms) if not n or not i or ms[i - 1] <= n}
        ends[j] = max([k for k in range(1, len(q) + 1) if place(q[-k:])[1] >= 0], default=0)
    found = matching.mems_in(p, t, width=seed)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    got = {r["pattern_id"]: r for r in search.longest_prefix_in(p, found).collect()}
    assert {j: r["matched"] for j, r in got.items()} == ends
    for j, r in got.items():
        n = r["matched"]
        assert (r["pos"] == -1 and r["text_id"] is None) if not n else texts[r["text_id"]][r["pos"] - n + 1 : r["pos"] + 1] == patterns[j][-n:]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_registered_matches_are_real(spark):
    rows = catalog.string_oracle_documents(spark, DIR).collect()
    assert rows and all(r["lcp"] == r["lcs"] == r["len"] for r in rows)
    items = {r["pattern_id"] for r in catalog.exist_benchmark(spark, DIR).where("found").collect()}
    whole = catalog._items(spark, DIR).select("pattern_id", F.length("seq").alias("len"))
    assert {r["pattern_id"] for r in catalog.mems_documents(spark, DIR).join(whole, ["pattern_id", "len"]).collect()} == items
    ends = catalog.longest_prefix_documents(spark, DIR).collect()
    assert len(ends) == whole.count() and max(r["matched"] for r in ends) > 50


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_registered_matches_by_plain_search(spark):
    docs = sorted((r["text_id"], r["text"]) for r in catalog._documents(spark, DIR).collect() if r["text"])
    whole, starts = "\x00".join(t for _, t in docs), []
    for i, t in docs:
        starts.append((starts[-1][0] + starts[-1][2] + 1 if starts else 0, i, len(t)))
    want = set()
    for r in catalog._items(spark, DIR).collect():
        p, before, n = r["seq"], None, 0
        for i in range(len(p)):
            n = max(n - 1, 0)
            while i + n < len(p) and p[i : i + n + 1] in whole:
                n += 1
            if not n or before is None or before <= n:
                at = whole.find(p[i : i + n]) if n else -1
                place = max(s for s in starts if s[0] <= at) if n else None
                want.add((r["pattern_id"], i, n, place[1] if n else None, at - place[0] if n else -1))
            before = n
    assert {tuple(r) for r in catalog.mems_documents(spark, DIR).collect()} == want
