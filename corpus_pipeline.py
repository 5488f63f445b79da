"""The corpus pipeline: documents in, token ids of the kept and cleaned documents out.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but
the last return the columns of documents. Rows without a doc_id go through all stages like
the others; of a group of near copies one row stays, one with the smallest doc_id if any has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from stringloom.llm.shared import fresh, hash_mod, settle, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from four fifths of the labels."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(hash_mod(F.col("doc_id"), 5) != 0)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return neardup.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more lies in benchmark windows."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced in its text and n_chars to match."""
    forest = secrets.train(spark)
    old = fresh(docs, "old_text")
    masked = secrets.mask(docs.withColumn(old, F.col("text")), forest)
    changed = F.col("text") != F.col(old)
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding the ids gives the text back."""
    import public_tokenizers as public

    small_batches(spark)
    vocabulary = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
    both = bpe.encode(docs.select("doc_id", "lang", "source", "text"), *vocabulary, decoded="decoded")
    same = F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode_ids),
]

#: The classifier, the forest and the tokenizer have no SQL form; tests hold near duplicates, decontamination,
#: secret scans and encoding against plain versions, and the classifier's scores against a plain forward pass.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
