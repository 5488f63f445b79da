"""Phrase tables against plain parses, and what is read out of them against the texts."""

import os
import random
from math import log2

import pytest
from pyspark.sql import functions as F

from stringloom.functions import strings
from stringloom.operators import parse, phrases
from stringloom.plans import catalog

DIR = "/root/testdata/sf0.001"


def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for letters in ("ab", "abé日", "a", "abcdefgh") for _ in range(6)]
    return ["", None, "a", "a" * 300, "abcabcabcabc" * 20, "\n \t\0x", "😀é😀é😀éa"] + made


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(odd_texts())], "text_id long, text string, ORD string, ch int").cache()


def by_text(table):
    out = {}
    for r in table.orderBy("text_id", "ord").collect():
        out.setdefault(r["text_id"], []).append((r["dst"], r["src"], r["len"], r["ch"]))
    return out


def test_lz77_is_the_fold(texts):
    want = {r[0]: [tuple(p) for p in r[1]] for r in texts.select("text_id", parse.lz77(F.col("text"))).collect() if r[1]}
    got = phrases.lz77(texts)
    assert got.columns == ["text_id", "ord", "dst", "src", "len", "ch"]
    assert by_text(got) == want
    assert [r["ord"] for r in got.where("text_id = 3").orderBy("ord").collect()] == list(range(len(want[3])))


def test_relative_is_the_fold(texts):
    split = texts.where(F.length("text") > 4).select("text_id", F.substring("text", 1, 4).alias("reference"), F.substring("text", 5, 1000).alias("text"))
    want = {r[0]: [(p["dst"] - 4, p["src"], p["len"], p["ch"]) for p in r[1]] for r in texts.where(F.length("text") > 4).select("text_id", parse.rlz(F.col("text"), F.lit(4))).collect()}
    assert by_text(phrases.relative(split)) == want
    assert {r[0]: r[1] for r in phrases.decode_relative(phrases.relative(split), split).collect()} == {r[0]: r[2] for r in split.collect()}
    bare = split.withColumn("reference", F.lit(None).cast("string"))
    assert phrases.relative(bare).agg(F.max("len")).first()[0] == 0


def test_lz_end_is_greedy(texts):
    for text_id, parts in by_text(phrases.lz_end(texts)).items():
        text, at, ends = odd_texts()[text_id], 0, []
        for dst, src, size, ch in parts:
            assert dst == at and text[dst : dst + size] == text[src : src + size] and ch == text[dst + size : dst + size + 1]
            assert size == 0 or src + size in ends
            longest = max((k for e in ends for k in range(1, min(e, len(text) - dst) + 1) if text[e - k : e] == text[dst : dst + k]), default=0)
            assert size == longest
            at += size + 1
            ends.append(min(at, len(text)))
        assert at >= len(text)


def test_lz_end_beyond_the_kept_prefix(spark):
    # ends that share NEAR characters before them, and differ further on
    rng = random.Random(1)
    tail = "".join(rng.choice("xyz") for _ in range(phrases.NEAR + 9))
    text = "".join(c + tail + d for c in "abc" for d in "qr") + "b" + tail + "a" + tail
    held = spark.createDataFrame([(1, text)], "text_id long, text string")
    ends = []
    for dst, _, size, _ in by_text(phrases.lz_end(held))[1]:
        assert size == max((k for e in ends for k in range(1, min(e, len(text) - dst) + 1) if text[e - k : e] == text[dst : dst + k]), default=0)
        ends.append(min(dst + size + 1, len(text)))


def test_prefix_is_the_first_least_estimate(texts):
    lengths = {r["text_id"]: r["prefix"] for r in phrases.prefix_lengths(texts, bits=2).collect()}
    for i, text in enumerate(odd_texts()):
        if not text:
            assert i not in lengths
            continue
        n, prefix, sizes = len(text), len(text) // 1024 + 1, []
        while prefix < n:
            m = at = 0
            while prefix + at < n:
                k = max(k for k in range(n - prefix - at + 1) if text[prefix + at : prefix + at + k] in text[:prefix])
                m, at = m + 1, at + k + 1
            sizes.append((int(prefix * 2 + m * (4 + log2(n / m) + max(prefix - 1, 1).bit_length())), prefix))
            if len(sizes) > 1 and sizes[-1][0] > min(s for s, _ in sizes[:-1]):
                break
            prefix = prefix * 2
        assert lengths[i] == (min(sizes)[1] if sizes else n)
    prefixed = phrases.prefix_lengths(texts)
    references = prefixed.select("text_id", F.substring("text", F.lit(1), F.col("prefix")).alias("reference"))
    again = {r[0]: r[1] for r in phrases.decode_relative(phrases.relative_to_prefix(prefixed), references).collect()}
    assert all(again.get(r["text_id"], "") == r["text"][r["prefix"] :] for r in prefixed.collect())


def test_reading_out(texts, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 16)  # phrases and spans over several blocks
    filed = phrases.filed(phrases.lz77(texts))
    every = texts.where(F.length("text") > 0).select("text_id", F.explode(F.sequence(F.lit(-1), F.length("text"))).alias("pos"))
    got = phrases.extract(filed, every.unionByName(every)).collect()
    assert sorted((r["text_id"], r["pos"], r["ch"]) for r in got) == [(i, p, c) for i, t in enumerate(odd_texts()) for p, c in enumerate(t or "")]
    heights = {(r["text_id"], r["pos"]): r["height"] for r in got}
    for i, parts in by_text(phrases.lz77(texts)).items():
        own = []
        for _, src, size, ch in parts:
            for k in range(size):
                own.append(own[src + k] + 1)
            own += [1] * len(ch)
        assert own == [heights[i, p] for p in range(len(own))]
    spans = texts.select("text_id", F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 400), (2, 40), (-3, 1), (5, 4), (900, 999))))).alias("s")).select("text_id", "s.*", F.lit(1).alias("shown"))
    for r in phrases.display(filed, spans).collect():
        text = odd_texts()[r["text_id"]] or ""
        assert r["shown"] == (None if r["start"] > r["end"] else text[max(r["start"], 0) : r["end"] + 1])
    assert phrases.display(filed, spans).count() == 5 * len(odd_texts())


def test_common_prefixes_and_suffixes(spark, texts):
    rng, rows = random.Random(6), []
    for i, t in enumerate(odd_texts()):
        if t:
            for _ in range(4):
                cut = rng.randrange(len(t))
                pattern = t[cut : cut + 200] + rng.choice(["", "Z", "a"]) if rng.random() < 0.7 else rng.choice("aZ") + t[: cut + 1]
                rows.append((len(rows), i, rng.choice([cut, rng.randrange(len(t))]), pattern, rng.randrange(len(pattern)) if rng.random() < 0.5 else 0, t))
    asked = spark.createDataFrame(rows, "id long, text_id long, t int, pattern string, p int, text string")
    filed = phrases.filed(phrases.lz77(texts))
    pattern, p, text, t = (F.col(c) for c in ("pattern", "p", "text", "t"))
    want = {r[0]: (r[1], r[2], tuple(r[3])) for r in asked.select("id", strings.lcp(pattern, p, text, t), strings.lcs(pattern, p, text, t), strings.lcs_char(pattern, p, text, t)).collect()}
    forwards = {r["id"]: r["n"] for r in phrases.agree(filed, asked, first=3).collect()}
    backwards = {r["id"]: (r["lcs"], r["char"]) for r in phrases.lcs_char(filed, asked).collect()}
    assert forwards == {i: w[0] for i, w in want.items()}
    assert backwards == {i: w[2] for i, w in want.items()} and max(w[0] for w in want.values()) > 48
    outside = spark.createDataFrame([(1, 3, 500, "aaaa", 3), (2, 3, 0, "a", 5), (3, 3, -1, "a", 0), (4, 3, None, None, None), (5, 0, 0, "a", 0)], "id long, text_id long, t int, pattern string, p int")
    for back in (False, True):
        assert sorted((r["id"], r["n"]) for r in phrases.agree(filed, outside, backwards=back).collect()) == [(i, 0) for i in range(1, 6)]


def test_nesting(texts):
    depths = {(r["text_id"], r["ord"]): r["depth"] for r in phrases.nesting(phrases.lz77(texts)).collect()}
    for i, parts in by_text(phrases.lz77(texts)).items():
        spans = {(src, src + size) for _, src, size, _ in parts if size}
        own = {}
        for s in sorted(spans, key=lambda s: s[0] - s[1]):
            own[s] = max((own[o] + 1 for o in own if o != s and o[0] <= s[0] and o[1] >= s[1]), default=0)
        assert [depths[i, k] for k in range(len(parts))] == [own.get((src, src + size)) for _, src, size, _ in parts]


def test_nothing(spark, texts):
    none = texts.where("text_id < 0")
    assert phrases.lz77(none).count() == phrases.lz_end(none).count() == phrases.prefix_lengths(none).count() == 0
    filed = phrases.filed(phrases.lz77(none))
    asked = spark.createDataFrame([(1, 0, 3)], "text_id long, start int, end int")
    assert [r["shown"] for r in phrases.display(filed, asked).collect()] == [""]
    assert phrases.nesting(phrases.lz77(none)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_whole_documents(spark):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    parsed = by_text(catalog.lz77_documents(spark, DIR))
    assert set(parsed) == {i for i, t in documents.items() if t}
    for i, parts in parsed.items():
        text, at = documents[i], 0
        for dst, src, size, ch in parts:
            assert dst == at and text[src : src + size] == text[dst : dst + size] and ch == text[dst + size : dst + size + 1]
            assert src + size <= dst and (size == 0 or text.find(text[dst : dst + size]) == src)
            assert dst + size == len(text) or text.find(text[dst : dst + size + 1], 0, dst) < 0
            at += size + 1
        assert at in (len(text), len(text) + 1)
    prefixes = {}
    for r in catalog.rlz_prefix_turns(spark, DIR).orderBy("text_id", "ord").collect():
        if r["ord"] < 0:
            prefixes[r["text_id"]] = r["len"]
        else:
            assert r["src"] + r["len"] <= prefixes[r["text_id"]]


def test_nesting_across_batches(spark):
    """Texts that go on from one Arrow batch to the next are told as a whole."""
    rows = [(t, o, 0, o % 7, o % 5, "x") for t in range(20) for o in range(3 + t)]
    frame = spark.createDataFrame(rows, "text_id int, ord int, dst int, src int, len int, ch string")
    want = sorted(map(tuple, phrases.nesting(frame).collect()), key=repr)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "4"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, phrases.nesting(frame).collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) == len(rows)


def test_reading_out_sends_no_positions_to_all(spark, texts):
    """Positions meet phrases by sort-merge joins, however small their files, and few phrases of a block."""
    index = phrases.filed(phrases.lz77(texts))
    assert index.groupBy("text_id", "block").count().agg({"count": "max"}).first()[0] <= 16
    asked = texts.where("length(text) > 0").selectExpr("text_id", "0 AS start", "length(text) - 1 AS end")
    plan = phrases.display(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_short_matches_are_known_from_one_sort(texts, monkeypatch):
    """The text is searched for long matches only; texts beyond LONG, searched from their first characters on, have the same phrases."""
    held = [t for t in odd_texts() if t]
    first, places = phrases._first_places(held)
    for k, at in enumerate(places, 1):
        assert all(at[b + i] == t.find(t[i : i + k]) for t, b in zip(held, first.tolist()) for i in range(len(t) - k + 1))

    class Text(str):
        finds = 0

        def find(self, *args):
            Text.finds += 1
            return str.find(self, *args)

    rng = random.Random(3)
    text = Text("".join(rng.choice("abcdefghijklmnop") for _ in range(3000)))
    _, places = phrases._first_places([text])
    known = phrases._known(places, phrases.np.arange(len(text) + 1))
    n = len(list(phrases._greedy(phrases._finder(text, known, 0, len(places), None), 0, len(text))))
    assert n > 500 and Text.finds < 20
    ways = [(phrases.lz77, texts), (phrases.lz_end, texts), (phrases.relative_to_prefix, phrases.prefix_lengths(texts))]
    want = [by_text(parse_(t)) for parse_, t in ways]
    lengths = sorted(map(tuple, phrases.prefix_lengths(texts).select("text_id", "prefix").collect()))
    monkeypatch.setattr(phrases, "LONG", 0)
    assert [by_text(parse_(t)) for parse_, t in ways] == want
    assert sorted(map(tuple, phrases.prefix_lengths(texts).select("text_id", "prefix").collect())) == lengths


def test_agreement_is_read_where_a_text_is_parsed(spark, texts, monkeypatch):
    """The same as by tables of phrases, and none is written."""
    rng, rows = random.Random(9), []
    for i, t in enumerate(odd_texts()):
        if t:
            for _ in range(4):
                cut = rng.randrange(len(t))
                pattern = t[cut : cut + 200] + rng.choice(["", "Z", "a"]) if rng.random() < 0.7 else rng.choice("aZ") + t[: cut + 1]
                rows.append((len(rows), i, rng.choice([cut, rng.randrange(len(t))]), pattern, rng.randrange(len(pattern)) if rng.random() < 0.5 else 0, t))
    asked = spark.createDataFrame(rows, "id long, text_id long, t int, pattern string, p int, text string")
    filed = phrases.filed(phrases.lz77(texts))
    forwards = {r["id"]: r["n"] for r in phrases.agree(filed, asked, first=3).collect()}
    backwards = {r["id"]: (r["lcs"], r["char"]) for r in phrases.lcs_char(filed, asked).collect()}
    monkeypatch.setattr(phrases, "settle_rows", None)
    both = F.expr("array(named_struct('t', t, 'p', p, 'back', false), named_struct('t', t, 'p', p, 'back', true))")
    got = {r["text_id"]: r["found"] for r in phrases.agree_in_rows(asked.select(F.col("id").alias("text_id"), "text", "pattern", both.alias("asked")).repartition(3), first=3).collect()}
    assert {i: f[0]["n"] for i, f in got.items()} == forwards and {i: tuple(f[1]) for i, f in got.items()} == backwards
    assert max(forwards.values()) > 48 and all(f[0]["char"] == (rows[i][5][rows[i][2] + f[0]["n"] :][:1] or None) for i, f in got.items() if rows[i][4] + f[0]["n"] < len(rows[i][3]))
    outside = spark.createDataFrame([(1, "abc", 500, "aaaa", 3), (2, "abc", 0, "a", 5), (3, "abc", -1, "a", 0), (4, "abc", None, None, None)], "text_id long, text string, t int, pattern string, p int")
    assert all(tuple(x) == (0, None) for r in phrases.agree_in_rows(outside.select("text_id", "text", "pattern", both.alias("asked"))).collect() for x in r["found"])


def test_turns_agree_without_tables_of_phrases(spark, monkeypatch, tmp_path):
    turns = [(1, 0, "one two three"), (1, 1, "one twofold tree"), (1, 2, ""), (2, 0, "aé日"), (2, 1, "bé日"), (2, 2, "bé日"), (3, 0, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(phrases, "settle_rows", None)
    got = catalog.lz77_agree_turns(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1 << 32, 7, 3, "h"), (2 << 32, 0, 2, "a"), ((2 << 32) + 1, 3, 3, None)]
    assert got.schema.simpleString() == "struct<text_id:bigint,lcp:int,lcs:int,char:string>"
