"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, line_dedup, neardup, ppm, secrets, spelling, token_files, topk, toxicity, url_rules
from .shared import hash_mod, table


#: The rules that the contract of op3 fixes; of those that fit, the longest wins.
SITE_RULES = [url_rules.host_rule(*x) for x in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]

#: The method's own rules for the other pages: unwanted words, and links from feeds.
WORD_RULES = [url_rules.word_rule(w) for w in ("adult", "betting", "casino", "escort", "porn", "sex", "torrent", "warez", "xxx")]
FEED_RULE = url_rules.Rule("feed", "block", r"[?&]utm_source=feed(?=[&#]|\Z)", ("utm", "source", "feed"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_chats(chat.format_chats(turns))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, [*SITE_RULES, *WORD_RULES, FEED_RULE])
    named = F.when(F.col("rule").isin([r.name for r in SITE_RULES]), F.col("rule"))
    return judged.select("page_id", url_rules.host(F.col("url")).alias("host"), url_rules.path(F.col("url")).alias("path"), named.alias("rule"), "verdict")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(spark)
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), forest)
    found = F.expr("filter(findings, x -> x.score >= 0.5)")
    return docs.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(found).cast("long").alias("n_secrets"), F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"))).alias("secrets"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, 5)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    vocabulary = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary, drop_text=True, decoded="decoded")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(hash_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (hash_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = hash_mod(F.col("doc_id"), 10)
    scored = ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    written = token_files.write(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"), end=2, width=2)
    return token_files.read(written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), least_chars=6, least=5, misspell=199)
    return spelling.group(words, ratio=5)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.digest(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.keep_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=40, least_docs=5)
    kept = line_dedup.kept_text(F.col("text"), F.col("keep"))
    return marked.select("doc_id", "n_lines", line_dedup.n_dropped(F.col("keep")).alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_url_filters": op3_url_filters,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_line_dedup": op13_line_dedup,
}
