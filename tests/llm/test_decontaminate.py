import random
import re

import pytest
from pyspark.sql import functions as F

from stringloom.llm import decontaminate as dc


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, n=13):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        for i in range(max(1, len(v) - n + 1)) if v else []:
            gram = v[i : i + n]
            for j in range(len(w) - len(gram) + 1):
                if w[j : j + len(gram)] == gram:
                    hit.update(range(j, j + len(gram)))
                    found.add(key)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    vocabulary = ["a", "B", "c1", "ümlaut", "日本", "d", "E", "of", "The"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 12, 13, 14, 30]))) for i in range(12)] + [(50, ""), (51, None), (52, "..."), (3, say(20)), (None, say(15)), (60, "dup words here"), (61, "dup words here")]
    docs = [None, "", "...", "dup Words, here!", say(500)] + [say(rng.randint(0, 30)) + ", " + rng.choice(items)[1:][0].__str__() + "! " + say(rng.randint(0, 40)) for _ in range(40)]
    docs += [docs[7], docs[7], (items[3][1] + "\n") * 400]
    rows = [(i if i != 9 else None, t, "x", 1) for i, t in enumerate(docs)]
    return items, rows, spark.createDataFrame(rows, "doc_id long, text string, found string, n_hit int"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [dc.MAX_TABLE_BYTES, 0])
def test_matches_brute_force(data, most):
    items, rows, docs, bench = data
    for name in ("spans", "items", "n_words", "row_number", "met", "hit", "hash_table", "contaminated"):
        docs = docs.withColumn(name, F.lit(7))
    got = dc.judge(docs, bench, max_bytes=most)
    assert sorted(got.columns) == sorted({*docs.columns, "n_items"})
    got = got.collect()
    assert all((r["found"], r["row_number"], r["met"], r["hit"], r["hash_table"]) == ("x", 7, 7, 7, 7) for r in got)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        n, hit, found = brute(r["text"], items)
        assert (r["n_words"], r["n_hit"], list(r["items"])) == (n, hit, found)
        assert r["n_items"] == len(found) and r["contaminated"] == (hit > 0 and 20 * hit >= n)
        by_id[r["doc_id"]] = r
    assert by_id[3]["contaminated"]


def test_removal(data):
    items, rows, docs, bench = data
    kept = dc.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    want = sorted(repr(r) for r in rows if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute(r[1], items)))
    assert sorted(repr(tuple(r)) for r in kept.collect()) == want


def test_spans(spark):
    bench = spark.createDataFrame([(1, "One two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zero, ONE two; three! four."), (2, "one two four"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dc.remove_spans(docs, bench, mask="").collect()}
    assert got[2] == "one two four" and got[3] is None
    assert words(got[1]) == ["zero", "four"] and got[1].startswith("Zero") and got[1].endswith("four.")


def test_empty_tables(spark, data):
    _, _, docs, bench = data
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.judge(docs, none).where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert dc.judge(docs.where(F.lit(False)), bench).collect() == []
