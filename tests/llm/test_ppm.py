import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stringloom.llm import ppm
from stringloom.llm.shared import hash_mod

ORDER = 3


def brute(texts, train):
    """Plain PPM-C with exclusion and the unigram base, symbol by symbol."""
    tables = [defaultdict(Counter) for _ in range(ORDER + 1)]

    def symbols(t):
        return [0] * ORDER + [b + 1 for b in t.encode()] + [0]

    for t, use in zip(texts, train):
        s = symbols(t)
        if use:
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    tables[k][tuple(s[i - k : i])][s[i]] += 1
    out = []
    for t in texts:
        s, total = symbols(t), 0.0
        for i in range(ORDER, len(s)):
            out_of, p = set(), 1.0
            for k in range(ORDER, -1, -1):
                c = {x: n for x, n in tables[k].get(tuple(s[i - k : i]), {}).items() if x not in out_of}
                if not c:
                    continue
                whole = sum(c.values()) + len(c)
                if s[i] in c:
                    p *= c[s[i]] / whole
                    break
                p *= len(c) / whole
                out_of |= c.keys()
            else:
                p /= 257 - len(out_of)
            total += math.log10(p)
        out.append(total)
    return out


def base(texts, train):
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        return [w for w in low.split(" ") if w] + [None]

    c = Counter(w for t, u in zip(texts, train) if u for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for t in texts]


def sample(seed, n):
    rng = random.Random(seed)
    letters = "aaabbcdE éñ \n\t日'"
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize("seed,nobody", [(1, False), (2, False), (3, True)])
def test_matches_brute_force(spark, seed, nobody):
    texts = sample(seed, 60) + ["same text again"] * 3
    df = spark.createDataFrame([(i, t if t or i % 2 else None, i) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    fold = hash_mod(F.col("doc_id"), 10)
    train = F.lit(False) if nobody else fold != 0
    clash = {name: F.lit("old") for name in (*ppm.RESULTS, "in_training", "train", "kind", "code")}
    scored = ppm.score(df.withColumns({"tr": train, **clash}), F.col("tr"), order=ORDER, block_bytes=700)
    assert sorted(scored.columns) == sorted(["doc_id", "text", "block", "tr", *clash])
    got = {r["doc_id"]: r for r in scored.collect()}
    assert all((r["in_training"], r["train"], r["block"]) == ("old", "old", r["doc_id"]) for r in got.values())
    use = [got[i]["tr"] for i in range(len(texts))]
    assert len(got) == len(texts) and (nobody or 0 < sum(use) < len(texts))
    for i, (p, b) in enumerate(zip(brute(texts, use), base(texts, use))):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == b[:3]
        assert r["base_score"] == pytest.approx(b[3], abs=1e-6)
        assert r["score"] == pytest.approx(p, abs=1e-6)


def test_long_text_in_runs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [None, "", "x" * 5, "abc déf " * 40, "q"]
    whole = list(ppm.grams(pa.array(texts), 4))
    monkeypatch.setattr(ppm, "CHUNK", 37)
    parts = defaultdict(list)
    for first, codes, counts in ppm.grams(pa.array(texts), 4):
        ends = np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(counts)):
            parts[first + i] += codes[ends[i] : ends[i + 1]].tolist()
    want, at = {}, 0
    (first, codes, counts), = whole
    for i, c in enumerate(counts):
        want[i] = codes[at : at + c].tolist()
        at += c
    assert dict(parts) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score(df, F.lit(True)).collect() == []


def test_default_looks_six_bytes_back(spark):
    texts = ["1abcde2 3abcde4 " * 20] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tr", F.col("doc_id") > 0)
    score = lambda **kw: {r["doc_id"]: r["score"] for r in ppm.score(df, F.col("tr"), **kw).collect()}[0]
    assert score() == pytest.approx(score(order=6), abs=1e-6)
    assert score() > score(order=4) + 10


def test_listing_is_shuffled_once(spark, monkeypatch):
    """Answers aren't written, the listing is read as it was dealt out, and rows and texts of all kinds come through their bundles."""
    written = []
    settle = ppm.settle
    monkeypatch.setattr(ppm, "settle", lambda df, purpose, *options: written.append(purpose) or settle(df, purpose, *options))
    texts = ["the cat sat", None, "", "日本 é the", "sat " * 300] * 3
    df = spark.createDataFrame([(i, t, i % 3 > 0, [i, None]) for i, t in enumerate(texts)], "doc_id long, text string, tr boolean, more array<int>")
    scored = ppm.score(df, F.col("tr"), order=3, block_bytes=500)
    assert "lm-answers" not in written
    assert "Bucketed: true" in scored._jdf.queryExecution().toString()
    got = {r["doc_id"]: r for r in scored.collect()}
    assert [(got[i]["text"], got[i]["tr"], got[i]["more"]) for i in range(len(texts))] == [(t, i % 3 > 0, [i, None]) for i, t in enumerate(texts)]
    one = {r["doc_id"]: r for r in ppm.score(df, F.col("tr"), order=3).collect()}
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"]) == (one[i]["n_tokens"], one[i]["n_known"])
        assert abs(r["score"] - one[i]["score"]) < 1e-9 and abs(r["base_score"] - one[i]["base_score"]) < 1e-9


def test_a_block_is_scored_piece_by_piece(spark):
    """No task gathers a block's text or its answers as one table, and rows come to Python in small batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    texts = [f"word{i} of {i * i} " * 2_000 for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    scored = ppm.score(df, F.col("doc_id") % 3 > 0, order=3)
    plan = scored._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    assert int(spark.conf.get(key)) <= 8 << 20
    spark.conf.set(key, "100k")  # several pieces and batches to a block; a smaller limit is kept
    few = {r["doc_id"]: r for r in ppm.score(df, F.col("doc_id") % 3 > 0, order=3, block_bytes=300_000).collect()}
    assert spark.conf.get(key) == "100k"
    spark.conf.unset(key)
    got = {r["doc_id"]: r for r in scored.collect()}
    use = [i % 3 > 0 for i in range(len(texts))]
    for i, b in enumerate(base(texts, use)):
        assert got[i]["text"] == few[i]["text"] == texts[i]
        for r in (got[i], few[i]):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == b[:3]
            assert r["base_score"] == pytest.approx(b[3], abs=1e-4)
        assert got[i]["score"] == pytest.approx(few[i]["score"], abs=1e-6)


def test_answers_are_sorted_in_little_room():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.choice(1 << 40, 800_000)
    codes = rng.permutation(np.unique(codes))
    values = np.sqrt(codes)
    tracemalloc.start()
    answers = ppm._Answers()
    for a in range(0, len(codes), 20_000):
        order = np.argsort(codes[a : a + 20_000])
        answers.add(codes[a : a + 20_000][order], values[a : a + 20_000][order])
    answers.sort()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * (codes.nbytes + values.nbytes)  # 3 times and more for one table sorted as a whole
    wanted = np.sort(np.concatenate([codes[::3], codes[::5] + 1, [-5, 1 << 41]]))
    have, value = answers.look(wanted)
    assert (have == np.isin(wanted, codes)).all() and have.sum() >= len(codes[::3])
    assert (value[have] == np.sqrt(wanted[have])).all()
    assert not ppm._Answers().look(wanted)[0].any()
