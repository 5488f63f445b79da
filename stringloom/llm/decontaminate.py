"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned per document.

The benchmark's windows, once their size in bytes has been checked, become one hash table
(an array of buckets) that executors build and that reaches every task once, as the value of
a subquery; each document's windows look themselves up in it without a shuffle, a hash match
is verified on the words, and the verified windows give hit words, items and spans. Beyond
the size bound the windows are joined by a shuffle instead. DataFrame functions only.

Defined cases: a null or empty text has no words, no hits and is clean; benchmark rows
without words give no window; an item whose id is null still marks words but is not
listed; repeated documents and items are judged one by one; extra columns are kept, but for
those that have the name of a result, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, let, lower_ascii, settle

#: What separates words: every ASCII character but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of the hash table up to which it is shipped to every task; beyond, a shuffle join.
MAX_TABLE_BYTES = 32 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("len", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1)
    return F.filter(parts, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(len, gram, items): every distinct window of the benchmark with the items that hold it."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    grams = w.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), n).alias("gram"))
    return grams.groupBy(F.size("gram").alias("len"), "gram").agg(F.collect_set("item").alias("items"))


def _hashed(windows: DataFrame) -> DataFrame:
    """The windows with the hash h of their words and the words joined by blanks, which no word holds."""
    return windows.select("len", F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))).alias("h"), F.array_join("gram", " ").alias("gram"), "items")


def _table(windows: DataFrame, buckets: int) -> DataFrame:
    """One row with the hash table: an array of buckets, each an array of (h, gram, items)."""
    filled = windows.groupBy(F.pmod("h", F.lit(buckets)).alias("id")).agg(F.collect_list(F.struct("h", "gram", "items")).alias("es"))
    every = windows.sparkSession.range(buckets).join(filled, "id", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", "es"))).alias("t")).select(F.transform("t", lambda x: F.coalesce(x["es"], F.array().cast(filled.schema["es"].dataType))))


def _starts(w: Column, size: int) -> Column:
    return F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text", found: str = "found", max_bytes: int = MAX_TABLE_BYTES) -> DataFrame:
    """The documents with a struct column `found`: n_words, spans (at from 1, len) and items.

    A window is n consecutive words of an item; an item of fewer words is one window.
    """
    windows = settle(_hashed(benchmark_windows(benchmark, n, item, item_text)), "benchmark-windows")
    own = F.lit(64) + F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda acc, x: acc + F.octet_length(x) + 16)
    sizes = {r["len"]: (r["c"], r["b"]) for r in windows.groupBy("len").agg(F.count("*").alias("c"), F.sum(own).alias("b")).collect()}  # n rows at most
    if not sizes:
        none = F.struct(F.size(words(F.col(text))).cast("long").alias("n_words"), F.array().cast(FOUND["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"))
        return docs.withColumn(found, none)
    if sum(b for _, b in sizes.values()) > max_bytes:
        return _scan_by_join(docs, windows, sorted(sizes), text, found)
    buckets = 1 << (2 * sum(c for c, _ in sizes.values())).bit_length()

    def record(table: Column) -> Column:
        def of(h: Column) -> Column:
            return F.element_at(table, (F.pmod(h, F.lit(buckets)) + 1).cast("int"))

        def of_length(w: Column, h: Column, size: int) -> Column:
            starts = _starts(w, size)
            hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, size)))
            at = let(hashes, lambda hs: F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), hs[i - 1].alias("h"))), lambda x: F.exists(of(x["h"]), lambda e: e["h"] == x["h"])))

            def verified(x: Column) -> Column:
                same = let(F.array_join(F.slice(w, x["at"], size), " "), lambda gram: F.filter(of(x["h"]), lambda e: e["gram"] == gram))
                return let(same, lambda es: F.struct(x["at"].alias("at"), F.lit(size).alias("len"), F.flatten(F.transform(es, lambda e: e["items"])).alias("items"), (F.size(es) > 0).alias("ok")))

            return F.filter(F.transform(at, verified), lambda x: x["ok"])

        def hits(w: Column) -> Column:
            return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*[of_length(w, h, k) for k in sorted(sizes)]))

        return let(words(F.col(text)), lambda w: let(hits(w), lambda x: _found(F.size(w), x)))

    # the table is the value of a subquery: executors build it, and it reaches the tasks once, beside the plan
    shipped = fresh(docs, "hash_table")
    return docs.withColumn(shipped, _table(windows, buckets).scalar()).withColumn(found, let(F.col(shipped), record)).drop(shipped)


def _found(n_words: Column, hits: Column) -> Column:
    """The struct `found` from verified hits (at, len, items)."""
    return F.struct(
        n_words.cast("long").alias("n_words"),
        F.array_sort(F.transform(hits, lambda y: F.struct(y["at"].alias("at"), y["len"].alias("len")))).alias("spans"),
        F.array_distinct(F.flatten(F.transform(hits, lambda y: y["items"]))).alias("items"),
    )


def _scan_by_join(docs: DataFrame, windows: DataFrame, lengths: list[int], text: str, found: str) -> DataFrame:
    """For benchmarks beyond the bound: the windows' hashes meet by a shuffle; hits are verified in the row.

    The rows are written with a number first, so that a task that runs again finds the same numbers.
    """
    row, met = fresh(docs, "row_number"), fresh(docs, "met")
    keyed = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")

    def of_length(w: Column, h: Column, size: int) -> Column:
        return F.transform(_starts(w, size), lambda i: F.struct(i.alias("at"), F.lit(size).alias("len"), F.xxhash64(F.slice(h, i, size)).alias("h")))

    def places(w: Column) -> Column:
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*[of_length(w, h, k) for k in lengths]))

    grams = keyed.select(F.col(row).alias("row"), F.explode(let(words(F.col(text)), places)).alias("g")).select("row", "g.*")
    candidates = grams.join(windows, ["len", "h"]).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("at", "len", "gram", "items")).alias(met))
    joined = keyed.join(candidates, row, "left")
    none = F.array().cast(candidates.schema[met].dataType)

    def record(w: Column) -> Column:
        same = F.filter(F.coalesce(met, none), lambda x: x["gram"] == F.array_join(F.slice(w, x["at"], x["len"]), " "))
        return _found(F.size(w), same)

    return joined.withColumn(found, let(words(F.col(text)), record)).select(*[c for c in docs.columns if c != found], found)


def hit_words(spans: Column) -> Column:
    """How many word positions the spans cover (sorted by start, they may overlap)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def judge(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, share: int = 20, **kw) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items, spans and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    found, hit = fresh(docs, "found"), fresh(docs, "hit")
    out = scan(docs, benchmark, n=n, found=found, **kw).withColumn(hit, hit_words(F.col(f"{found}.spans")))
    return out.withColumns(
        {
            "n_words": F.col(f"{found}.n_words"),
            "n_hit": F.col(hit),
            "n_items": F.size(f"{found}.items").cast("long"),
            "items": F.array_sort(f"{found}.items"),
            "spans": F.col(f"{found}.spans"),
            "contaminated": (F.col(hit) > 0) & (share * F.col(hit) >= F.col(f"{found}.n_words")),
        }
    ).drop(found, hit)


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, **kw) -> DataFrame:
    """Without the contaminated documents; every other row is kept as it is."""
    found, hit = fresh(docs, "found"), fresh(docs, "hit")
    out = scan(docs, benchmark, found=found, **kw).withColumn(hit, hit_words(F.col(f"{found}.spans")))
    bad = (F.col(hit) > 0) & (share * F.col(hit) >= F.col(f"{found}.n_words"))
    return out.where(~bad).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", mask: str = " ", **kw) -> DataFrame:
    """Each document with its hit words, and what stands before each of them, replaced by the mask.

    Everything else stays byte for byte.
    """
    found = fresh(docs, "found")
    out = scan(docs, benchmark, text=text, found=found, **kw)
    word = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+"
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([^a-z0-9A-Z\x{80}-\x{10FFFF}]*)(" + word + r"|$)"), 0)

    def cut(ps: Column) -> Column:
        covered = lambda i: F.exists(f"{found}.spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["len"]))
        return F.array_join(F.transform(ps, lambda p, i: F.when(covered(i) & p.rlike(word), F.lit(mask)).otherwise(p)), "")

    cleaned = F.when(F.size(f"{found}.spans") > 0, let(pieces, cut)).otherwise(F.col(text))
    return out.withColumn(text, cleaned).select(*docs.columns)
