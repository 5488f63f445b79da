"""Occurrences over phrases against a plain search, for patterns short and long, on odd and repetitive texts."""

import random

import pytest
from pyspark.sql import functions as F

from stringloom.operators import fm, occurrences, phrases


def plain(pattern, text):
    return [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]


def made():
    rng = random.Random(11)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for letters in ("ab", "abé日", "a", "abcdefgh") for _ in range(4)]
    passage = "".join(rng.choice("abcdef ") for _ in range(150))
    texts += [None, "", "a", "a" * 200, "abcabcabcabc" * 20, "😀é😀é😀éa", passage + "x" + passage + passage[:40], passage[:100] + "y" + passage[40:] + passage, "".join(rng.choice("ab") for _ in range(700))]
    patterns = ["a", "ab", "aaaa", "abc", "é", "😀é", "zz", None, "", passage, passage[20:90], passage[:33], "abc" * 40, "a" * 200, "a" * 201, "f￿", "ab"]
    patterns += [t[i : i + n] for t in texts if t for n in (1, 3, 8, 40) for i in (rng.randrange(len(t)),)]
    return texts, patterns


@pytest.mark.parametrize(("parse", "key"), [("lz77", 3), ("lz_end", 32)])
def test_equal_a_plain_search(spark, parse, key):
    texts, patterns = made()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "text_id long, text string, PLACE string")
    asked = spark.createDataFrame([(f"p{i}", p, 1) for i, p in enumerate(patterns)], "pattern_id string, seq string, x int")
    parsed = getattr(phrases, parse)(docs)
    literals = {}
    for r in parsed.where(F.length("ch") > 0).collect():
        literals.setdefault(r["text_id"], set()).add(r["dst"] + r["len"])
    got = occurrences.locate_all(asked, parsed, docs, key=key).collect()
    want = sorted((f"p{i}", j, at, len(p)) for i, p in enumerate(patterns) if p for j, t in enumerate(texts) if t for at in plain(p, t))
    assert sorted(tuple(r)[:4] for r in got) == want
    assert any(r["copies"] > 1 for r in got)
    for r in got:
        assert (r["copies"] == 0) == any(r["pos"] <= e < r["pos"] + r["len"] for e in literals[r["text_id"]])


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, None)], "text_id long, text string")
    none = spark.createDataFrame([], "pattern_id long, seq string")
    assert occurrences.locate_all(none, phrases.lz77(docs), docs).collect() == []
    empty = docs.where("false")
    assert occurrences.locate_all(none.union(spark.createDataFrame([(1, "a")], none.schema)), phrases.lz77(empty), empty).collect() == []


def test_boxes_of_either_shape(spark):
    rng = random.Random(3)
    points = [(i, y) for i, y in enumerate(rng.sample(range(600), 600))]
    boxes = [(i, *sorted(rng.choices(range(600), k=2)), *sorted(rng.choices(range(600), k=2))) for i in range(60)] + [(60, 5, 4, 0, 9), (61, 0, 599, 7, 7), (62, 7, 7, 0, 599)]
    got = fm.points_in(spark.createDataFrame(points, "x long, y long"), spark.createDataFrame(boxes, "box_id long, x0 long, x1 long, y0 long, y1 long"))
    want = [(b, x, y) for b, x0, x1, y0, y1 in boxes for x, y in points if x0 <= x <= x1 and y0 <= y <= y1]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equal_borders_are_sorted_once(spark, monkeypatch):
    """Copies of texts add no keys to the sorts, and a frequent key's borders are all found, sent to the tasks or by a shuffle."""
    sizes = {}
    settle = occurrences.settle

    def counted(df, purpose, **options):
        out = settle(df, purpose, **options)
        sizes.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(occurrences, "settle", counted)
    texts = ["red ring SMALL red ring", "hot bolt LARGE hot bolt", "aé" * 40]
    asked = spark.createDataFrame([(w, w) for w in ("red", "ring", "hot bolt", "r", "éa", "aé" * 20)], "pattern_id string, seq string")
    seen = []
    for copies, sent in ((1, occurrences.SENT), (20, occurrences.SENT), (20, 0)):
        monkeypatch.setattr(occurrences, "SENT", sent)
        monkeypatch.setattr(occurrences, "HOT", 3)
        sizes.clear()
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * copies)], "text_id long, text string")
        got = occurrences.locate_all(asked, phrases.lz77(docs), docs, key=8).collect()
        want = sorted((w, i, at, len(w)) for (w,) in asked.select("seq").collect() for i, t in enumerate(texts * copies) for at in plain(w, t))
        assert sorted(tuple(r)[:4] for r in got) == want
        seen.append((sizes["borders"][0], sizes["keys"]))
    assert seen[1][0] == seen[2][0] == 20 * seen[0][0]
    assert seen[0][1] == seen[1][1] == seen[2][1]


@pytest.mark.parametrize("held", [occurrences.HELD, 0])
def test_located_where_parsed(spark, monkeypatch, held):
    """The same occurrences, and as many copies on the way to them, without a table of phrases; too many patterns go by tables."""
    monkeypatch.setattr(occurrences, "HELD", held)
    purposes = []
    settle = occurrences.settle
    monkeypatch.setattr(occurrences, "settle", lambda df, purpose, **options: purposes.append(purpose) or settle(df, purpose, **options))
    texts, patterns = made()
    texts, patterns = (texts, patterns) if held else (texts[:6], patterns[:5])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "text_id long, text string, PLACE string").repartition(2)
    asked = spark.createDataFrame([(f"p{i}", p, 1) for i, p in enumerate(patterns)], "pattern_id string, seq string, x int")
    found = occurrences.locate_in_rows(asked, docs)
    got = sorted(map(tuple, found.collect()))
    assert (purposes == []) == (held > 0)
    assert [r[:4] for r in got] == sorted((f"p{i}", j, at, len(p)) for i, p in enumerate(patterns) if p for j, t in enumerate(texts) if t for at in plain(p, t))
    monkeypatch.setattr(occurrences, "settle", settle)
    by_tables = occurrences.locate_all(asked.where("length(seq) < 20"), phrases.lz77(docs), docs) if held else found
    short = {f"p{i}" for i, p in enumerate(patterns) if p and len(p) < 20} if held else {r[0] for r in got}
    assert sorted(map(tuple, by_tables.collect())) == [r for r in got if r[0] in short]
    assert occurrences.locate_in_rows(asked.where("false"), docs).collect() == [] == occurrences.locate_in_rows(asked, docs.where("false")).collect()
    assert found.schema.simpleString() == by_tables.schema.simpleString()


def test_long_words_of_documents_leave_no_tables(spark, monkeypatch, tmp_path):
    from stringloom.plans import catalog

    spark.createDataFrame([(1, "a benchmark item"), (2, "another BENCHMARK, item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, "the benchmark of benchmarks"), (6, None), (7, "BENCHMARK")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(occurrences, "settle", None)
    assert sorted(map(tuple, catalog.occurrences_documents(spark, str(tmp_path)).collect())) == [("BENCHMARK", 7, 0, 9), ("benchmark", 5, 4, 9), ("benchmark", 5, 17, 9)]
