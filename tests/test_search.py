import random

import pytest
from pyspark.sql import functions as F

from stringloom.functions import strings
from stringloom.operators import parse, search
from stringloom.sources import texts as sources

PAPER = "AATAATATGATAATAAAGA"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    texts = [PAPER, "", None, "ababababab", "x"] + ["".join(rng.choice("abc é") for _ in range(rng.choice([3, 50, 700]))) for _ in range(20)]
    patterns = ["ATA", "AATA", "GATAATAAAG", "AAG", "G", "ZZ", "", None, "abab", "ab", PAPER, PAPER + "A", texts[-1][:25], texts[-2][1:18]]
    return (
        texts,
        patterns,
        spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"),
        spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, seq string"),
    )


def brute(text, p):
    return [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p] if text and p else []


def test_locate(tables):
    texts, patterns, t, p = tables
    found = search.locate_all(p, t)
    want = {(j, i, x, len(q)) for j, q in enumerate(patterns) for i, s in enumerate(texts) for x in brute(s, q)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    counts = {r["pattern_id"]: (r["n"], r["n_texts"]) for r in search.count(p, found).collect()}
    assert counts == {j: (sum(w[0] == j for w in want), len({w[1] for w in want if w[0] == j})) for j in range(len(patterns))}
    assert {r["pattern_id"] for r in search.exist(p, found).where("found").collect()} == {w[0] for w in want}
    one = {r["pattern_id"]: (r["text_id"], r["pos"]) for r in search.locate_one(p, found).collect()}
    assert one[5] == (None, -1) and one[2] == (0, 8)
    assert search.locate_max(found, 1).groupBy("pattern_id").count().where("count > 1").count() == 0
    last = {(r["pattern_id"], r["text_id"]): r["pos"] for r in search.toehold(found, t).collect()}
    assert [last[(j, 0)] for j in range(5)] == [4, 3, 8, 15, 8]
    assert search.verify(found, p, t).count() == 0
    assert search.verify(found.withColumn("pos", F.col("pos") + 1), p, t).count() > 0


def test_mems_golden(spark):
    golden = {
        "ATGATTATAG": [(0, 5), (5, 3), (6, 3), (8, 2)], "GGTAATATGA": [(0, 1), (1, 1), (2, 8)], "ACAATAAAGA": [(0, 1), (1, 0), (2, 8)], "GATAATAAAG": [(0, 10)],
        "TTATATGATA": [(0, 1), (1, 3), (2, 8)], "AAAAAATAAT": [(0, 3), (1, 3), (2, 3), (3, 3), (4, 6)], "": [], "A": [(0, 1)], "C": [(0, 0)], "TT": [(0, 1), (1, 1)], PAPER: [(0, 19)], PAPER + "A": [(0, 19), (18, 2)],
    }
    df = spark.createDataFrame([(p, PAPER) for p in golden] + [("x", None)], "p string, t string")
    got = {p: [] for p in golden}
    for r in search.mems(df, "p", "p", "t").collect():
        got[r["p"]].append((r["start"], r["len"]))
        assert r["text_pos"] == (PAPER.find(r["p"][r["start"] : r["start"] + r["len"]]) if r["len"] else -1)
    assert {p: sorted(v) for p, v in got.items()} == golden


def test_longest_prefix(spark):
    rng = random.Random(8)
    pairs = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(1, 8))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(pairs, "k long, p string, t string")

    def lcs(p, t, e):
        n = 0
        while n < len(p) and n <= e and p[len(p) - 1 - n] == t[e - n]:
            n += 1
        return n

    for r in search.longest_prefix(df, "k", "p", "t").collect():
        _, p, t = pairs[r["k"]]
        best = max(lcs(p, t, e) for e in range(len(t)))
        assert r["matched"] == best
        assert (r["pos"] == -1) if best == 0 else lcs(p, t, r["pos"]) == best


def test_prefixes_and_owners(spark):
    words = spark.createDataFrame([("abc",), ("abd",), ("b",), (None,)], "w string")
    asked = spark.createDataFrame([("ab",), ("b",), ("abcd",), ("",)], "q string")
    assert sorted(tuple(r) for r in search.with_prefix(words, "w", asked, "q").collect()) == [("", "abc"), ("", "abd"), ("", "b"), ("ab", "abc"), ("ab", "abd"), ("b", "b")]
    places = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 99), (2, 3)], "g long, at long")
    starts = spark.createDataFrame([(1, 10, 0), (1, 11, 5), (2, 12, 4)], "g long, doc long, s long")
    assert sorted((r["g"], r["at"], r["doc"], r["offset"]) for r in search.owners(places, starts, "g", "at", "doc", "s").collect() if r["doc"]) == [(1, 0, 10, 0), (1, 4, 10, 4), (1, 5, 11, 0), (1, 99, 11, 94)]


def test_scalars(spark):
    df = spark.createDataFrame([("banana", "bandana", 1), ("", "x", 0), (None, "x", 0)], "a string, t string, i int")
    r = df.select(strings.extract(F.col("t"), F.col("i")).alias("e"), strings.display(F.col("t"), F.col("i"), F.lit(99)).alias("d"), strings.common_prefix(F.col("a"), F.col("t")).alias("c"), strings.lcs_char(F.col("a"), F.lit(5), F.col("t"), F.lit(6)).alias("l"), strings.occurrences(F.col("a"), F.lit("ana")).alias("o")).collect()
    assert (r[0]["e"], r[0]["d"], r[0]["c"], tuple(r[0]["l"]), r[0]["o"]) == ("a", "andana", 3, (3, "d"), [1, 3])
    assert (r[1]["e"], r[1]["c"], r[1]["o"]) == ("x", 0, []) and r[2]["c"] is None
    dna = spark.createDataFrame([("ACGTacgtTTT" * 9,), ("",), ("AXC",), (None,)], "t string")
    packed = dna.select("t", strings.dna_pack(F.col("t")).alias("b")).select("t", "b", strings.dna_unpack(F.col("b"), F.length("t")).alias("u")).collect()
    assert [x["u"] for x in packed] == ["ACGTACGTTTT" * 9, "", None, None]
    assert df.select(F.length(strings.as_bytes(F.lit("é日"))).alias("n")).first()["n"] == 5


def test_parses(spark):
    rng = random.Random(4)
    texts = [PAPER, "", None, "a", "aaaaaaa"] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 60))) for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    t = F.col("text")
    rows = df.select("text", parse.lz77(t).alias("z"), parse.decode(parse.lz77(t)).alias("dz"), parse.decode(parse.lz_end(t)).alias("de"), parse.decode_rlz(parse.rlz(t, F.lit(5)), F.substring(t, F.lit(1), F.lit(5))).alias("dr")).collect()
    assert [(p["src"], p["len"], p["ch"]) for p in rows[0]["z"]] == [(0, 0, "A"), (0, 1, "T"), (0, 3, "A"), (2, 1, "G"), (1, 6, "A"), (0, 1, "G"), (0, 1, "")]
    for r in rows:
        assert r["dz"] == r["de"] == r["dr"] == r["text"]
    phrases = parse.pfp_phrases(df, "text_id", "text", w=3, p=4)
    dictionary = parse.pfp_dictionary(phrases)
    ordered = [r["phrase"] for r in dictionary.orderBy("rank").collect()]
    assert ordered == sorted(set(ordered))
    back = {r["text_id"]: r["text"] for r in parse.pfp_unparse(parse.pfp_parse(phrases, dictionary), dictionary, w=3).collect()}
    assert back == {i: x for i, x in enumerate(texts) if x}


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\0two")
    (tmp_path / "empty.txt").write_text("")
    assert [r["text"] for r in sources.read_texts(spark, str(tmp_path / "*.txt")).collect()] == ["one"]
    (tmp_path / "p.fa").write_text("> I\nATG\n> II\nGG\n> III")
    got = [tuple(r)[1:] for r in sources.read_patterns(spark, str(tmp_path / "p.fa")).orderBy("pattern_id").collect()]
    assert got == [(0, "> I", "ATG"), (1, "> II", "GG")]
    (tmp_path / "i.txt2").write_text("# number=1\n3,9\n")
    assert [tuple(r) for r in sources.read_intervals(spark, str(tmp_path / "i.txt2")).collect()] == [(3, 9)]
    found = spark.createDataFrame([("> I", -1, 3)], "header string, pos int, len int")
    assert sources.occurrence_lines(found).first()["line"] == "-1 3"
    mems = spark.createDataFrame([("> I", 5, 3, 5), ("> I", 0, 5, 6)], "header string, start int, len int, text_pos int")
    lines = sources.mem_lines(mems, "header")
    assert lines.first()["line"] == "(0 5 6) (5 3 5) "
    sources.write_lines(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    clean = spark.createDataFrame([("ANGN\nx",), (None,), ("",)], "t string").select(sources.remove_n(F.col("t")), sources.keep_dna(F.col("t")), sources.strip_newlines(F.col("t")), sources.replace_n(F.col("t"))).collect()
    assert clean[0][:3] == ("AG\nx", "AG", "ANGNx") and "N" not in clean[0][3] and clean[1][0] is None and clean[2][3] == ""


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_seeds_in_pieces(spark, monkeypatch, step):
    """Seeds of all sizes, also across the pieces of a long text, and none across texts."""
    monkeypatch.setattr(search, "STEP", step)
    texts = ["abcabcabcabcabcabcabcabc", "bca", "é日😀é日😀" * 5, "a\0b", "", None, "x" * 40]
    seeds = ["a", "bc", "cab", "日😀é", "abcabcabcabcabca", "x" * 16, "\0b", "ab", "bcab", "zz"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "text_id long, text string")
    got = search.places_of(spark.createDataFrame([(s,) for s in seeds], "seed string"), frame)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, p, s) for i, t in enumerate(texts) for s in seeds for p in range(len(t or "")) if t.startswith(s, p))
    assert sorted(map(tuple, got.collect())) == want
