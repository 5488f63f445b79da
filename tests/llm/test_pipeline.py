import os

import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def test_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for i, (name, stage) in enumerate(cp.STAGES):
        out = cp.settle(stage(spark, docs, DIR), name)
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert 0 < out.count() <= docs.count()
            assert out.where(F.col("n_chars") != F.length("text")).count() == docs.where(F.col("n_chars") != F.length("text")).count()
        else:
            assert out.count() == docs.count() and out.where(~F.col("round_trip")).count() == 0
        docs = out


def test_stages_equal_plain_versions(spark):
    import public_tokenizers as public
    import tiktoken
    from test_decontaminate import brute as windows
    from test_neardup import brute as near

    import corpus_pipeline as cp
    from stringloom.llm import bpe

    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 120").cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = cp.settle(cp.drop_near_copies(spark, docs, DIR), "kept")
    want = {i for i, (_, c) in near(list(texts.items()), 5).items() if i == c}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    clean = cp.settle(cp.drop_contaminated(spark, kept, DIR), "clean")
    bad = lambda n, hit, _: hit > 0 and 20 * hit >= n
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i in want if not bad(*windows(texts[i], items))}
    path = public.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=bpe.Codec(path, public.PATTERN).ranks, special_tokens={})
    for r in cp.encode_ids(spark, clean, DIR).collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_odd_rows_pass_all_stages(spark):
    import corpus_pipeline as cp

    secret = "the key is password=3d4bc476f7469ffa8a as said"
    rows = [(None, None), (None, ""), (1, secret), (1, secret), (2, "word " * 3000), (None, "one two three four five six"), (None, "one two three four five six"), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, findings string, spans string, old_text string")
    for frame, n in ((docs, 7), (docs.limit(0), 0)):
        for name, stage in cp.STAGES:
            out = cp.settle(stage(spark, frame, DIR), name)
            if name != "byte_bpe":
                assert out.columns == docs.columns and {tuple(r) for r in out.select("findings", "spans", "old_text").collect()} <= {("x", "y", "z")}
                frame = out
        assert out.count() == n and out.where("not round_trip").count() == 0
        assert not n or [r["n_chars"] for r in frame.where("doc_id = 1").collect()] == [len("the key is password=[SECRET] as said")]
