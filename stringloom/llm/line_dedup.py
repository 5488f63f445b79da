"""Line dedup: lines that many documents share stay in one document only; keep bitmaps instead of texts.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
least `least_chars` code points found in at least `least_docs` documents lose all their lines
except those of the largest doc_id that holds them.

Lines leave the texts as two hashes of their key (96 bits), doc_id, a hash of the text and
their position. These rows are dealt out by ranges of the key's hash and sorted by key,
document (largest first) and position, and then streamed: a key's first document keeps its
lines, and the rank of its last document says how many hold it. Keys with more than a
HOT_SHARE of all rows don't take that way: they are found by counts of hash buckets, summed
up before the shuffle, and marked by a broadcast of their sums, so no task meets a hot key
whole. There are at most HOT_SHARE such keys.

What comes back is a bitmap of each document's lines, compressed to run lengths: kept and
dropped lines in turn, kept lines first ([3, 2, 1]: three kept, two dropped, one kept).

Defined cases: a null or empty text is one empty line, which is kept. Rows with the same
doc_id are one document; a null doc_id is a document of its own, before all others. Repeated
rows get the same bitmap. An empty table gives an empty table. A column of the input that has
the name of a result, in any case, is replaced; others are kept. Texts of any length are
split whole; only their lines' hashes are shuffled together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, fresh, settle, without

#: ASCII white space, which is stripped at both ends of a line.
WHITE = " \t\n\x0b\x0c\r"

#: A key is hot with more than one in HOT_SHARE of all rows, and more than HOT_ROWS.
HOT_SHARE, HOT_ROWS, BUCKETS = 4096, 1000, 1 << 16


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has an empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """(doc_id, text_key, pos, h, g): position and hashes of every line whose key has so many code points."""
    each = docs.where(F.length("text") >= least_chars).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = each.where(F.length("line") >= least_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars)
    return keyed.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))


def repeated(lines: DataFrame, least_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, pos) of the lines that go. lines: a settled table of long_lines."""
    bucket = F.pmod("h", F.lit(BUCKETS))
    sizes = {r["b"]: r["n"] for r in lines.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}  # BUCKETS numbers at most
    most = max(HOT_ROWS, sum(sizes.values()) // HOT_SHARE)
    full = [b for b, n in sizes.items() if n > most]
    # few of the rows of a full bucket are of other keys; their sums per key are made before the shuffle
    sums = lines.where(bucket.isin(full)).groupBy("h", "g").agg(F.count("*").alias("n"), F.countDistinct(F.struct("doc_id")).alias("n_docs"), F.max("doc_id").alias("last"))
    hot = settle(sums.where(F.col("n") > most), "hot-lines")
    met = lines.join(F.broadcast(hot), ["h", "g"], "left")
    hot_gone = met.where((F.col("n_docs") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("last")))

    ordered = Window.partitionBy("h", "g").orderBy(F.desc_nulls_last("doc_id"))
    streamed = met.where(F.col("n").isNull()).select("doc_id", "text_key", "pos", "h", "g").repartitionByRange("h").sortWithinPartitions("h", "g", F.desc_nulls_last("doc_id"), "pos").withColumn("nth", F.dense_rank().over(ordered))
    counted = streamed.withColumn("n_docs", F.max("nth").over(Window.partitionBy("h", "g")))
    gone = counted.where((F.col("n_docs") >= least_docs) & (F.col("nth") > 1))
    return gone.select("doc_id", "text_key", "pos").unionByName(hot_gone.select("doc_id", "text_key", "pos"))


def run_lengths(dropped: Column, n: Column) -> Column:
    """Run lengths of a bitmap of n lines from the ascending positions of those that are dropped."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: F.coalesce(F.get(dropped, i + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))
    after = lambda r, i: F.when(i > 0, F.get(r, i - 1)["b"]).otherwise(0)
    return F.transform(F.array(runs), lambda r: F.concat(F.flatten(F.transform(r, lambda x, i: F.array(x["a"] - after(r, i), x["b"] - x["a"]))), F.array(n - after(r, F.size(r)))))[0]


def keep_bitmaps(docs: DataFrame, *, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs with n_lines (long) and keep (array of int), the run lengths of kept and dropped lines in turn."""
    lines = settle(long_lines(docs.select("doc_id", "text"), least_chars), "lines")
    gone = repeated(lines, least_docs)
    per_doc = gone.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    plain = without(docs, "n_lines", "keep")
    names = [fresh(plain, x) for x in ("of_doc", "of_text", "gone")]
    own = per_doc.toDF(*names)
    met = plain.join(own, plain["doc_id"].eqNullSafe(own[names[0]]) & (F.xxhash64(plain["text"]) == own[names[1]]), "left")
    n = F.size(split_lines(F.col("text")))
    positions = F.coalesce(F.col(names[2]), F.array().cast("array<int>"))
    return met.select(*plain.columns, n.cast("long").alias("n_lines"), run_lengths(positions, n).alias("keep"))


def n_dropped(keep: Column) -> Column:
    """How many lines a bitmap drops."""
    return F.aggregate(F.filter(keep, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines, joined by line feeds; empty where none is kept."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    runs = F.transform(keep, lambda n, i: F.struct(n.alias("n"), (i % 2 == 0).alias("kept")))

    def kept(lines: Column) -> Column:
        add = lambda s, r: F.struct((s["at"] + r["n"]).alias("at"), F.when(r["kept"], F.concat(s["out"], F.slice(lines, s["at"], r["n"]))).otherwise(s["out"]).alias("out"))
        return F.array_join(F.aggregate(runs, start, add, lambda s: s["out"]), "\n")

    whole = F.size(keep) == 1
    return F.when(whole, F.coalesce(text, F.lit(""))).otherwise(F.transform(F.array(split_lines(text)), kept)[0])


def drop_repeated(docs: DataFrame, *, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs with the repeated lines taken out of their texts; texts that lose none stay as they are."""
    marked = keep_bitmaps(docs, least_chars=least_chars, least_docs=least_docs)
    return marked.withColumn("text", F.when(F.size("keep") == 1, F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep")))).drop("n_lines", "keep")
