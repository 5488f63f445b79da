import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stringloom.operators import fm, index, suffix

PAPER = "AATAATATGATAATAAAGA"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    return [PAPER, "banana"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(8)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")


def test_variants(spark, frame, tmp_path):
    sa, opt, pa = (index.build(frame, v) for v in index.VARIANTS)
    assert [r["pos"] for r in sa.where("text_id = 0").orderBy("ord").collect()] == [16, 15, 11, 17, 8, 5, 10, 7]
    assert [tuple(r)[:4] for r in sa.orderBy("text_id", "ord").collect()] == [tuple(r)[:4] for r in opt.orderBy("text_id", "ord").collect()]
    assert pa.where("text_id = 0").count() == len(PAPER)
    index.store(sa, str(tmp_path / "i"))
    with pytest.raises(AnalysisException):
        index.store(sa, str(tmp_path / "i"))
    index.store(sa, str(tmp_path / "i"), replace=True)
    assert {r["stored"] for r in sa.collect()} == {index.KEY} and {r["stored"] for r in opt.collect()} == {5}
    assert index.load(spark, str(tmp_path / "i")).count() == sa.count()
    assert index.stored_bytes(sa).where("text_id = 0").first()["entries"] == 8
    with pytest.raises(ValueError):
        index.build(frame, "other")
    assert index.key_length(100, 8) == 14 and 5 <= index.key_length(10**6, 10**5, "opt-sA") <= 16


def test_lookup_finds_every_prefix(spark, frame, texts):
    pa = index.build(frame, "PA")
    rng, rows = random.Random(2), []
    for i, t in enumerate(texts):
        for _ in range(5):
            a = rng.randrange(len(t))
            rows.append((len(rows), i, t[a : a + rng.randint(1, 9)]))
        rows.append((len(rows), i, "zz"))
    got = {r["pattern_id"]: r["pos"] for r in index.lookup(pa, spark.createDataFrame(rows, "pattern_id long, text_id long, seq string"), frame).collect()}
    for k, i, p in rows:
        assert (k in got) == (p in texts[i])
        if k in got:
            assert texts[i][got[k] - len(p) + 1 : got[k] + 1] == p


def test_backward_count_and_lf(spark, frame, texts):
    ordered = suffix.suffixes(frame)
    rows = [(k, i, p) for k, (i, p) in enumerate((i, p) for i in range(len(texts)) for p in ("a", "ab", "ATA", "AATA", "ana", "zz", texts[i], texts[i] + "q"))]
    got = {r["pattern_id"]: r["n"] for r in fm.backward_count(spark.createDataFrame(rows, "pattern_id long, text_id long, seq string"), ordered).collect()}
    for k, i, p in rows:
        assert got[k] == sum(texts[i].startswith(p, x) for x in range(len(texts[i]))), (texts[i], p)
    sa = {(r["text_id"], r["rank"]): r["sa"] for r in ordered.collect()}
    for r in fm.last_to_first(ordered).collect():
        assert sa[r["text_id"], r["lf"]] == sa[r["text_id"], r["rank"]] - 1


def test_phi_and_locate_all_from_run_samples(spark, frame, texts):
    ordered = suffix.suffixes(frame).cache()
    sa = {(r["text_id"], r["rank"]): r["sa"] for r in ordered.collect()}
    after = {(t, p): sa.get((t, k - 1)) for (t, k), p in sa.items()}
    samples = fm.phi_samples(ordered)
    runs = {r["text_id"]: r["runs"] for r in suffix.run_counts(ordered).collect()}
    assert all(r["count"] == runs[r["text_id"]] - 1 for r in samples.groupBy("text_id").count().collect())
    places = ordered.where("rank > 0").select("text_id", F.col("sa").alias("pos"))
    got = {(r["text_id"], r["pos"]): r["phi"] for r in fm.phi(places, samples).collect()}
    assert got == {k: v for k, v in after.items() if k in got} and len(got) == len(sa) - len(texts)
    rows = [(k, i, p) for k, (i, p) in enumerate((i, p) for i in range(len(texts)) for p in ("a", "ab", "ATA", "zz", texts[i]))]
    found = fm.locate_all(fm.backward_count(spark.createDataFrame(rows, "pattern_id long, text_id long, seq string"), ordered), ordered)
    want = {(k, i, x) for k, i, p in rows for x in range(len(texts[i])) if texts[i].startswith(p, x)}
    listed = [tuple(r) for r in found.collect()]
    assert len(listed) == len(set(listed)) and set(listed) == want
    ordered.unpersist()


def test_points(spark):
    points = spark.createDataFrame([(1, 1), (70, 5), (200, 9)], "x long, y long")
    boxes = spark.createDataFrame([(1, 0, 100, 0, 5), (2, 60, 300, 6, 9)], "box_id long, x0 long, x1 long, y0 long, y1 long")
    assert sorted(tuple(r) for r in fm.points_in(points, boxes).collect()) == [(1, 1, 1), (1, 70, 5), (2, 200, 9)]


def test_lookup_compares_the_whole_prefix(spark):
    text = "x" + "abcdefghijklmnop" + "y" + "abcdefghijklmnop"
    one = spark.createDataFrame([(0, text)], "text_id long, text string")
    asked = ["yabcdefghijklmnop", "zabcdefghijklmnop", "xabcdefghijklmnop", "p", "q" * 40, text]
    rows = spark.createDataFrame([(i, 0, p) for i, p in enumerate(asked)], "pattern_id long, text_id long, seq string")
    pa = index.build(one, "PA")
    got = {r["pattern_id"]: r["pos"] for r in index.lookup(pa, rows, one).collect()}
    assert set(got) == {0, 2, 3, 5} and (got[0], got[2], got[5]) == (33, 16, 33) and text[got[3]] == "p"


@pytest.mark.parametrize("variant", ["opt-sA"])
def test_locate_one_through_the_index(spark, frame, texts, variant):
    rng, rows = random.Random(3), []
    for i, t in enumerate(texts):
        asked = [t, t + "a", t[1:], t[:-1], "", None, "zz", t[-1] * 3]
        for _ in range(12):
            a = rng.randrange(len(t))
            asked.append(t[a : a + rng.randint(1, 30)])
            asked.append("".join(rng.choice("abcATG") for _ in range(rng.randint(1, 6))))
        rows += [(k, i, p) for k, p in enumerate(asked)]
    rows += [(0, 99, "a")]
    built = index.build(frame, variant).cache()
    pairs = spark.createDataFrame(rows, "pattern_id long, text_id long, seq string")
    got = {(r["pattern_id"], r["text_id"]): r["pos"] for r in index.locate_one(built, pairs, frame).collect()}
    assert len(got) == len(rows)
    for k, i, p in rows:
        at = got[k, i]
        if i == 99 or not p or p not in texts[i]:
            assert at == -1, (texts[min(i, 9)], p)
        else:
            assert texts[i][at : at + len(p)] == p


def plain_stats(p, t):
    return [max(k for k in range(j + 2) if p[j + 1 - k : j + 1] in t) for j in range(len(p))]


@pytest.mark.parametrize("variant,key", [("sA", None), ("opt-sA", None), ("PA", 2)])
def test_mems_and_longest_prefix_through_the_index(spark, tmp_path, variant, key):
    rng = random.Random(7)
    block = "".join(rng.choice("abc") for _ in range(30))
    texts = [PAPER, "abcdefghijklmnopqrst" * 6, "a" * 50, "".join(block + rng.choice("xyé") for _ in range(8)), "".join(rng.choice("ab") for _ in range(120)), "é", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    rows = []
    for i, t in enumerate(texts):
        for p in ("ATGATTATAG", "GGTAATATGA", "ACAATAAAGA", "zz", "", None, "a" * 60, block * 2, (t or "x") + "q", (t or "y")[-40:]):
            rows.append((f"p{len(rows)}", i, p))
        for _ in range(4):
            a, b = (rng.randrange(len(t)) if t else 0 for _ in range(2))
            rows.append((f"p{len(rows)}", i, (t or "")[a : a + 40] + rng.choice("abz") + (t or "")[b : b + 33]))
    rows.append(("none", 99, "abc"))
    pairs = spark.createDataFrame(rows, "pattern_id string, text_id long, seq string")
    index.store(index.build(frame, variant, key=key), str(tmp_path / "i"))
    stored = index.load(spark, str(tmp_path / "i"))
    of = {(k, i): (p, texts[i]) for k, i, p in rows if i != 99}
    want = {k: (p, t, plain_stats(p, t)) for k, (p, t) in of.items() if p and t}
    got = {(r["pattern_id"], r["text_id"]): r["stats"] for r in index.matching_statistics(stored, pairs, frame).collect()}
    assert got.keys() == want.keys()
    for k, (p, t, stats) in want.items():
        assert [x["len"] for x in got[k]] == stats, (p, t)
        assert all(x["pos"] == -1 if not x["len"] else t[x["pos"] + 1 - x["len"] : x["pos"] + 1] == p[j + 1 - x["len"] : j + 1] for j, x in enumerate(got[k]))
    mems = {}
    for r in index.mems(index.matching_statistics(stored, pairs, frame)).collect():
        p, t, _ = want[r["pattern_id"], r["text_id"]]
        assert r["text_pos"] == -1 if not r["len"] else t[r["text_pos"] : r["text_pos"] + r["len"]] == p[r["start"] : r["start"] + r["len"]]
        mems.setdefault((r["pattern_id"], r["text_id"]), set()).add((r["start"], r["len"]))
    for k, (p, t, stats) in want.items():
        assert mems[k] == {(j + 1 - n if n else j, n) for j, n in enumerate(stats) if not n or j == len(p) - 1 or stats[j + 1] <= n}
    tails = {(r["pattern_id"], r["text_id"]): r for r in index.longest_prefix(stored, pairs, frame).collect()}
    for k, (p, t, stats) in want.items():
        r = tails[k]
        if not r["matched"]:
            assert r["pos"] == -1 and r["stop"] is None
            continue
        common = next((n for n in range(len(p) + 1) if n == len(p) or n > r["pos"] or t[r["pos"] - n] != p[-1 - n]), len(p))
        assert r["matched"] == common and r["stop"] == (t[r["pos"] - common] if common <= r["pos"] else None)
        assert r["matched"] == stats[-1] or variant != "PA"


@pytest.mark.parametrize("variant", index.VARIANTS)
def test_an_index_lies_in_its_text_s_row(spark, frame, texts, monkeypatch, variant):
    """Only texts and what is asked of them are shuffled, once; longer texts, by joins, have the same entries."""
    rows = frame.withColumn("asked", F.array(F.struct(F.lit(0).alias("pattern_id"), F.lit("ATATGA").alias("seq")), F.struct(F.lit(1).alias("pattern_id"), F.lit(None).cast("string").alias("seq"))))
    found = index.search(index.in_rows(rows, variant, key=3), "statistics")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r["text_id"]: r["found"] for r in found.collect()}
    for i, t in enumerate(texts):
        assert [x["len"] for x in got[i][0]] == plain_stats("ATATGA", t) and got[i][1] is None
    want = sorted(map(tuple, index.build(frame, variant, key=3).collect()))
    assert "Window" not in index.build(frame, variant, key=3)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(suffix, "LONG", 15)
    assert sorted(map(tuple, index.build(frame, variant, key=3).collect())) == want


def test_texts_and_patterns_without_characters(spark):
    rows = spark.createDataFrame([(1, "", ["a", ""]), (2, None, ["a"]), (3, "aa", None), (4, "ba", []), (5, "ba", ["ba", None, "ab"])], "text_id long, text string, seqs array<string>")
    asked = F.transform("seqs", lambda s, i: F.struct(i.alias("pattern_id"), s.alias("seq")))
    got = index.answers(index.search(index.in_rows(rows.select("text_id", "text", asked.alias("asked")), "opt-sA"), "whole")).collect()
    assert sorted((r["text_id"], r["pattern_id"], *r["found"]) for r in got) == [(1, 0, 0, -1), (2, 0, 0, -1), (5, 0, 2, 1), (5, 2, 1, 0)]
