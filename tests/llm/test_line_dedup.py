import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stringloom.llm import line_dedup, queries

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows):
    """Kept lines of each (doc_id, text)."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(doc)
    last = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in holders.items() if len(d) >= 5}
    return [[line for line in (text or "").split("\n") if last.get(key(line), doc) == doc] for doc, text in rows]


def corpus():
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcÄéXYZ ") for _ in range(39)) + e for e in ("q", "É", "zz")] + ["x" * 39, "Y" * 40, "日本" * 20]
    rows = [(None, shared[0]), (None, shared[4] + "\n" + shared[4])]
    for i in range(60):
        lines = [rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 12))]
        lines = [rng.choice(["", "  ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", " "]) for x in lines]
        rows.append((i // 2 if i < 20 else i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "\n".join([shared[0]] * 3000)), (74, shared[5] + "\n"), (74, shared[5] + "\n"), rows[40], rows[40]]
    return rows


@pytest.mark.parametrize("hot", [0, 1000])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in ("Keep", "N_LINES", "of_doc", "gone", "h", "pos", "key"):
        docs = docs.withColumn(c, F.lit("own"))
    marked = line_dedup.keep_bitmaps(docs)
    assert sorted(marked.columns) == sorted(["doc_id", "text", "of_doc", "gone", "h", "pos", "key", "n_lines", "keep"])
    got = marked.withColumn("kept", line_dedup.kept_text(F.col("text"), F.col("keep"))).withColumn("n", line_dedup.n_dropped(F.col("keep"))).collect()
    want = [(d, t, "\n".join(k), len((t or "").split("\n")), len((t or "").split("\n")) - len(k)) for (d, t), k in zip(rows, brute(rows), strict=True)]
    assert sorted(((r["doc_id"], r["text"], r["kept"], r["n_lines"], r["n"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(sum(r["keep"]) == r["n_lines"] and min(r["keep"][1:-1], default=1) > 0 and (r["gone"], r["pos"]) == ("own", "own") for r in got)
    assert any(r["n"] > 1 for r in got)


def test_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    out = line_dedup.drop_repeated(docs)
    assert out.columns == docs.columns
    want = [(d, t if len(k) == len((t or "").split("\n")) else "\n".join(k), "en") for (d, t), k in zip(rows, brute(rows), strict=True)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_query_and_empty_table(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, H int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_line_dedup(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    want = [(d, len((t or "").split("\n")), len((t or "").split("\n")) - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for (d, t), k in zip(rows, brute(rows), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert line_dedup.keep_bitmaps(spark.createDataFrame([], "doc_id long, text string")).collect() == []
