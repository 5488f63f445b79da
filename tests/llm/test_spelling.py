import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from stringloom.llm import queries, spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a))) if len(a) == len(b) else any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(counts, ratio=5):
    forms, rows = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)] if len(w) >= 5 else []
        found = [v for v in found if len(v) >= 5]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * n:
            forms[w] = best
        rows[w] = (n, len(found))
    out = set()
    for w, (n, k) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, k, counts.get(forms.get(w))))
    return out


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    for alphabet in ("ab", "abcdé", "aàüz日"):
        words = {"".join(rng.choice(alphabet) for _ in range(rng.choice([1, 4, 5, 6, 7, 8, 12]))) for _ in range(250)}
        words |= {w[:i] + rng.choice(alphabet) + w[i + rng.randint(0, 1) :] for w in list(words)[:120] for i in [rng.randint(0, len(w))]} | {"a" * 6, "a" * 7, "a" * 8, "abababab", "bababab"}
        counts = {w: rng.choice([5, 6, 25, 30, 125, 700, 4000, 25000]) for w in words}
        df = spark.createDataFrame(list(counts.items()), "word string, n long")
        got = [tuple(r) for r in spelling.group(df).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(counts)


def test_pivots_are_disjoint_and_cheapest(spark):
    rng = random.Random(2)
    rows = [([(rng.randint(1, 9), "xy", p) for p in rng.sample(range(1, 9), rng.randint(3, 5))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "p array<struct<c:bigint,g:string,pos:int>>")
    for r in df.select("p", spelling.pivots(F.col("p")).alias("v")).collect():
        a, b = r["v"]
        assert abs(a["pos"] - b["pos"]) >= 2
        assert a["c"] + b["c"] == min(x["c"] + y["c"] for x in r["p"] for y in r["p"] if x["pos"] <= y["pos"] - 2)


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiorstÄöé×") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    say = lambda n: "".join(rng.choice(words).capitalize() + rng.choice([" ", ", ", "1", "\n", "日"]) for _ in range(n))
    rows = [(i if i % 50 else None, say(rng.randint(0, 60))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "Straße" * 3 + " " + "x" * 40_000)] + [(5, "Xylophon xylophone")] * 12
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, word string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_spelling_variants(spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert {tuple(r) for r in got.collect()} == brute(plain_words(rows))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(spelling.count_words(none, misspell=199)).collect() == []
