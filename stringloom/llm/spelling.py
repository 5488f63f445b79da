"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by pivotal grams.

Bigrams are ordered by how few words hold them, then by themselves. A word's prefix is its
three first bigrams in that order, with all that tie with the third; its pivots are two
bigrams of the prefix that don't overlap, chosen by dynamic programming for the smallest sum
of frequencies. One edit can break only one of two disjoint bigrams. So of two near words,
the one whose prefix ends earlier in the order has a pivot that stands in the other's prefix:
pivots are looked up among prefixes. What stands before the edit keeps its place and what
follows it moves by the difference of the lengths, so pivot and prefix meet by an equi-join
of bigram, position and length, and no bigram's words meet all at once. Candidates are
verified by their edit distance.

Words are counted in parts before they are shuffled; a common word is one row per task.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text in
the hash that misspells. Words of fewer than SHORTEST code points have no near words. Repeated
rows count again. An empty table gives an empty table. Columns other than doc_id and text are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, settle

#: ASCII and Latin-1 letters, with the two signs among the latter.
RUN = "([A-Za-zÀ-ÿ]+)"

#: Words need three bigrams, of which two are disjoint, also after one deletion.
SHORTEST = 5


def _lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def misspelt(doc_id: Column, word: Column, every: int) -> Column:
    """The word without one code point if crc32 of `<doc_id>:<word>` is a multiple of `every`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(docs: DataFrame, *, least_chars: int = 6, least: int = 5, misspell: int | None = None) -> DataFrame:
    """(word, n): the words of the texts with at least so many code points and occurrences.

    With misspell, one in so many occurrences loses a code point, as a hash of doc_id and word says.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(_lower(F.col("text")), F.lit(RUN), 1)).alias("run")).where(F.length("run") >= least_chars)
    words = runs.select((misspelt(F.col("doc_id"), F.col("run"), misspell) if misspell else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pivots(prefix: Column) -> Column:
    """The two disjoint grams of least total frequency among a prefix: array of (c, g, pos) in any order.

    Dynamic programming along the positions: the cheapest gram that ends before the present
    one, the gram just before it, and the cheapest pair so far.
    """
    gram = "struct<c:bigint,g:string,pos:int>"
    none = F.lit(None)
    start = F.struct(none.cast(gram).alias("free"), none.cast(gram).alias("held"), none.cast(f"struct<cost:bigint,a:{gram},b:{gram}>").alias("pair"))

    def step(s: Column, x: Column) -> Column:
        free = F.when(s["held"]["pos"] <= x["pos"] - 2, F.least(s["free"], s["held"])).otherwise(s["free"])
        pair = F.when(free.isNotNull(), F.struct((free["c"] + x["c"]).alias("cost"), free.alias("a"), x.alias("b")))
        return F.struct(F.least(s["free"], s["held"]).alias("free"), x.alias("held"), F.least(s["pair"], pair).alias("pair"))

    along = F.array_sort(prefix, lambda a, b: a["pos"] - b["pos"])
    return F.aggregate(along, start, step, lambda s: F.array(s["pair"]["a"], s["pair"]["b"]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words. words: a settled table (word, n), each word once."""
    sized = words.select("word", "n", F.length("word").alias("size")).where(F.col("size") >= SHORTEST)
    spots = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.struct(i.alias("pos"), F.substring("word", i, F.lit(2)).alias("g")))
    grams = sized.select("word", "n", "size", F.inline(spots))
    counts = grams.groupBy("g").agg(F.count("*").alias("c"))
    own = grams.join(counts, "g").groupBy("word", "n", "size").agg(F.array_sort(F.collect_list(F.struct("c", "g", "pos"))).alias("grams"))
    third = F.struct(F.col("grams")[2]["c"].alias("c"), F.col("grams")[2]["g"].alias("g"))
    cut = own.withColumn("last", third).withColumn("prefix", F.filter("grams", lambda x: F.struct(x["c"].alias("c"), x["g"].alias("g")) <= F.col("last")))
    table = settle(cut.select("word", "n", "size", "last", "prefix", pivots(F.col("prefix")).alias("pivots")), "grams")

    prefixes = table.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "size", F.col("last").alias("b_last"), F.explode("prefix").alias("x")).select("b", "b_n", "size", "b_last", "x.g", "x.pos")
    # (change of length, change of position) that one edit allows
    moves = F.array(*(F.struct(F.lit(d).alias("longer"), F.lit(m).alias("by")) for d, m in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))))
    asked = table.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "size", F.col("last").alias("a_last"), F.explode("pivots").alias("x"), moves.alias("moves")).select("a", "a_n", "size", "a_last", "x", F.explode("moves").alias("m"))
    asked = asked.select("a", "a_n", "a_last", (F.col("size") + F.col("m.longer")).alias("size"), F.col("x.g").alias("g"), (F.col("x.pos") + F.col("m.by")).alias("pos"))
    met = asked.join(prefixes, ["g", "pos", "size"]).where((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")
    both = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(both).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to; every round doubles the steps taken.

    A form's count is a multiple of its word's, so chains are at most logarithmic in the counts.
    """
    reached = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = settle(reached.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        reached = further.drop("moved")
        if not further.where("moved").limit(1).count():
            return reached


def group(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n).

    A word's form is its near word of the largest n, ties to the smaller word, if that n is at
    least `ratio` (2 or more) times the word's; root is the last form, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 doesn't bound the chains of forms")
    words = settle(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.less") >= ratio * F.col("n")
    judged = settle(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
