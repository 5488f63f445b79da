"""Readers and writers of texts, pattern batches and results; cleaning and sampling of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle


def read_texts(spark: SparkSession, path: str, *, stop_at_nul: bool = True) -> DataFrame:
    """(path, text): a row per file, up to its first NUL; files without text give no row."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    text = F.substring_index("value", "\0", 1) if stop_at_nul else F.col("value")
    return files.select("path", text.alias("text")).where(F.length("text") > 0)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files with their numbers from 0, read in parallel over the files' splits.

    Lines are numbered inside their split, and splits by the lines before them in the file, so
    only a row per split is brought together.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", r"\r$", "").alias("value"), F.monotonically_increasing_id().alias("nth"))
    lines = settle(raw, "lines")
    sizes = lines.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("path", "split", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("path", "split").orderBy("nth")) - 1
    return lines.withColumn("inside", inside).join(starts, ["path", "split"]).select("path", (F.col("before") + F.col("inside")).alias("line"), "value")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(path, pattern_id, header, seq) of files of alternating header and sequence lines; a last header alone is left out.

    Header and sequence find each other by line number, also where a split ends between them.
    """
    pairs = numbered_lines(spark, path).withColumn("pattern_id", F.floor(F.col("line") / 2)).groupBy("path", "pattern_id")
    both = pairs.agg(F.max(F.when(F.col("line") % 2 == 0, F.col("value"))).alias("header"), F.max(F.when(F.col("line") % 2 == 1, F.col("value"))).alias("seq"))
    return both.where(F.col("seq").isNotNull()).select("path", F.col("pattern_id").cast("long").alias("pattern_id"), "header", "seq")


def read_interval_header(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, length, file) of header lines `# number=3 length=10 file=text`."""
    form = r"^#\s*number=(\d+)\s+length=(\d+)\s+file=(.*)$"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("value").rlike(form))
    return lines.select("path", *(F.regexp_extract("value", form, i).cast(kind).alias(n) for i, n, kind in ((1, "number", "long"), (2, "length", "int"), (3, "file", "string"))))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(from, to) of lines `from,to` below a header that starts with #."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains(","))
    parts = F.split("value", ",")
    return lines.select(parts[0].cast("int").alias("from"), parts[1].cast("int").alias("to"))


def occurrence_lines(found: DataFrame) -> DataFrame:
    """(header, line): `pos len`, with -1 for a pattern that is absent."""
    return found.select("header", F.concat_ws(" ", "pos", "len").alias("line"))


def mem_lines(mems: DataFrame, header: str) -> DataFrame:
    """(header, line): `(start len pos) ` for every match of a pattern, on one line."""
    listed = F.array_sort(F.collect_list(F.struct("start", "len", "text_pos")))
    shown = F.transform(listed, lambda m: F.concat(F.lit("("), m["start"], F.lit(" "), m["len"], F.lit(" "), m["text_pos"], F.lit(") ")))
    return mems.groupBy(header).agg(F.array_join(shown, "").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Header and line of each result as a text line of its own."""
    lines.select(F.concat_ws("\n", "header", "line").alias("value")).write.text(path)


def drop_last_newline(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n\x00]\z", "")


def strip_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def remove_n(text: Column) -> Column:
    return F.replace(text, F.lit("N"), F.lit(""))


def keep_dna(text: Column) -> Column:
    return F.regexp_replace(text, "[^ACGT]", "")


def replace_n(text: Column, seed: int = 0) -> Column:
    """Every N becomes a base that its position and the seed choose."""
    base = lambda i: F.substring(F.lit("ATCG"), F.pmod((i + seed) * 7 + F.floor((i + seed) / 4), F.lit(4)).cast("int") + 1, F.lit(1))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c, i: F.when(c == "N", base(i)).otherwise(c)), "")


LCG_A, LCG_C, LCG_M = 1_103_515_245, 12_345, 1 << 31


def sample_patterns(texts: DataFrame, text_id: str, text: str, *, number: int, length: int, seed: int = 0) -> DataFrame:
    """(text_id, pattern_id, header, seq): `number` substrings of each text that is long enough, at places a linear generator gives."""
    room = F.length(text) - length + 1
    drawn = texts.where(room > 0).select(F.col(text_id).alias("text_id"), F.col(text).alias("_t"), room.alias("_room"), F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("i"))
    turn = (F.col("text_id").cast("long") % 1_000_003 * 31 + F.col("i") * 7919 + seed) % LCG_M
    at = (turn * LCG_A + LCG_C) % LCG_M % F.col("_room")
    return drawn.select("text_id", F.col("i").cast("long").alias("pattern_id"), F.concat(F.lit(">pattern"), F.col("i")).alias("header"), F.substring("_t", at.cast("int") + 1, F.lit(length)).alias("seq"))


def query_stats(patterns: DataFrame, seq: str = "seq") -> DataFrame:
    """(patterns, characters) of a batch."""
    return patterns.agg(F.count("*").alias("patterns"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).alias("characters"))


def insert(keywords: DataFrame, more: DataFrame) -> DataFrame:
    """The distinct keywords of both."""
    return keywords.unionByName(more).distinct()


def erase(keywords: DataFrame, gone: DataFrame) -> DataFrame:
    return keywords.join(gone, keywords.columns, "left_anti")


def char_runs(texts: DataFrame, text_id: str, chars: DataFrame) -> DataFrame:
    """(text_id, run, ch, length): runs of equal characters of (text_id, pos, ch)."""
    w = Window.partitionBy(text_id).orderBy("pos")
    new = F.when(F.lag("ch").over(w).eqNullSafe(F.col("ch")), 0).otherwise(1)
    return chars.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(text_id, "run").agg(F.first("ch").alias("ch"), F.count("*").alias("length"))
