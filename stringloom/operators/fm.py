"""Run-length and FM operators over the BWT table: rank, LF steps, backward counting, phrase statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle_rows


def first_column(ordered: DataFrame) -> DataFrame:
    """(text_id, ch, before): how many suffixes start with a smaller character (the terminator counts)."""
    counts = ordered.where(F.col("bwt").isNotNull()).groupBy("text_id", F.col("bwt").alias("ch")).agg(F.count("*").alias("n"))
    smaller = F.sum("n").over(Window.partitionBy("text_id").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("text_id", "ch", (F.coalesce(smaller, F.lit(0)) + 1).alias("before"))


def last_to_first(ordered: DataFrame) -> DataFrame:
    """(text_id, rank, ch, lf): for every rank the rank of the suffix one character longer; null at the whole text."""
    seen = F.row_number().over(Window.partitionBy("text_id", "bwt").orderBy("rank")) - 1
    numbered = ordered.where(F.col("bwt").isNotNull()).select("text_id", "rank", F.col("bwt").alias("ch"), seen.alias("seen"))
    return numbered.hint("merge").join(first_column(ordered), ["text_id", "ch"]).select("text_id", "rank", "ch", (F.col("before") + F.col("seen")).cast("int").alias("lf"))


def first_to_last(ordered: DataFrame) -> DataFrame:
    """(text_id, rank, ch, fl): for every rank its suffix's first character and the rank of the suffix one character shorter."""
    return last_to_first(ordered).select("text_id", F.col("lf").alias("rank"), "ch", F.col("rank").alias("fl"))


def phi_samples(ordered: DataFrame) -> DataFrame:
    """(text_id, at, phi): for the first suffix of every BWT run but the very first, its position and that of the suffix before it in order."""
    w = Window.partitionBy("text_id").orderBy("rank")
    starts = ordered.withColumn("phi", F.lag("sa").over(w)).withColumn("new", ~F.col("bwt").eqNullSafe(F.lag("bwt").over(w)))
    return starts.where("new and rank > 0").select("text_id", F.col("sa").alias("at"), "phi")


def phi(places: DataFrame, samples: DataFrame) -> DataFrame:
    """places (text_id, pos, ...) with phi, the position of the suffix just before in suffix order; null at the smallest.

    Inside a run both suffixes of a pair step back together, so the nearest sample at or before
    a position gives its phi by the distance: an as-of join over as many rows as there are runs.
    """
    have = samples.select("text_id", F.col("at").alias("pos"), F.struct("at", "phi").alias("sample"), F.lit(0).alias("kind"))
    asked = places.select("text_id", "pos", F.struct(*places.columns).alias("row"), F.lit(1).alias("kind"))
    w = Window.partitionBy("text_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = have.unionByName(asked, allowMissingColumns=True).withColumn("s", F.last("sample", True).over(w)).where("kind = 1")
    return met.select("row.*", (F.col("s.phi") + F.col("pos") - F.col("s.at")).alias("phi"))


def locate_all(ranges: DataFrame, ordered: DataFrame) -> DataFrame:
    """(pattern_id, text_id, pos): all occurrences, from the ranges of backward_count and the samples at run borders.

    The last suffix of a range is looked up, phi gives those before it: a round for every
    occurrence of the commonest pattern, for all patterns at once.
    """
    samples = settle_rows(phi_samples(ordered), "phi-samples")
    ends = ranges.where("n > 0").select("pattern_id", "text_id", F.col("n").alias("left"), (F.col("high") - 1).alias("rank"))
    state = settle_rows(ends.join(ordered.select("text_id", "rank", F.col("sa").alias("pos")), ["text_id", "rank"]).select("pattern_id", "text_id", "left", "pos"), "phi-state")
    found = state
    while state.where("left > 1").limit(1).count():
        moved = phi(state.where("left > 1"), samples)
        state = settle_rows(moved.select("pattern_id", "text_id", (F.col("left") - 1).alias("left"), F.col("phi").alias("pos")), "phi-state")
        found = found.unionByName(state)
    return found.select("pattern_id", "text_id", "pos")


def backward_count(patterns: DataFrame, ordered: DataFrame) -> DataFrame:
    """(pattern_id, text_id, n, low, high): occurrences of each pattern (pattern_id, text_id, seq) in its text by backward search, at the ranks from low to below high.

    One step per pattern character, for all patterns at once: the range of ranks shrinks by
    the rank of the next character at both ends, looked up in a table of running counts.
    Patterns that die leave the loop, so it ends after the longest surviving pattern.
    """
    step = Window.partitionBy("text_id", "bwt").orderBy("rank")
    occ = settle_rows(ordered.where(F.col("bwt").isNotNull()).select("text_id", F.col("bwt").alias("ch"), "rank", F.row_number().over(step).alias("upto")), "occ")
    first = settle_rows(first_column(ordered), "first")
    sizes = ordered.groupBy("text_id").agg((F.max("rank") + 1).alias("size"))
    state = settle_rows(patterns.where(F.length("seq") > 0).join(sizes, "text_id").select("pattern_id", "text_id", "seq", F.lit(0).cast("long").alias("low"), F.col("size").cast("long").alias("high"), F.length("seq").alias("left")), "fm-state")
    done = None
    while state.where("left > 0").limit(1).count():
        open_ = state.where("left > 0").withColumn("ch", F.substring("seq", F.col("left"), F.lit(1)))

        def rank(df: DataFrame, bound: str, name: str) -> DataFrame:
            """Occurrences of ch among the ranks below the bound: an as-of look-up by union and window."""
            asks = df.select("text_id", "ch", F.col(bound).cast("long").alias("at"), "pattern_id", F.lit(None).cast("int").alias("upto"))
            have = occ.select("text_id", "ch", (F.col("rank") + 1).cast("long").alias("at"), F.lit(None).cast("long").alias("pattern_id"), "upto")
            w = Window.partitionBy("text_id", "ch").orderBy("at", F.col("upto").isNull()).rowsBetween(Window.unboundedPreceding, 0)
            return have.unionByName(asks).withColumn(name, F.coalesce(F.last("upto", True).over(w), F.lit(0))).where(F.col("upto").isNull()).select("text_id", "pattern_id", name).hint("merge")

        keyed = open_.join(first, ["text_id", "ch"], "left")
        moved = keyed.join(rank(open_, "low", "a"), ["text_id", "pattern_id"]).join(rank(open_, "high", "b"), ["text_id", "pattern_id"])
        low, high = F.coalesce(F.col("before") + F.col("a"), F.lit(0)), F.coalesce(F.col("before") + F.col("b"), F.lit(0))
        after = moved.select("pattern_id", "text_id", "seq", low.alias("low"), high.alias("high"), F.when(high > low, F.col("left") - 1).otherwise(0).alias("left"))
        closed = state.where("left = 0")
        done = closed if done is None else done.unionByName(closed)
        state = settle_rows(after, "fm-state")
    ended = state if done is None else done.unionByName(state)
    size = F.greatest(F.lit(0), F.col("high") - F.col("low"))
    return ended.select("pattern_id", "text_id", size.alias("n"), "low", "high")


def phrase_depth(phrases: DataFrame) -> DataFrame:
    """(text_id, phrases, copied, longest): counts of LZ phrases (text_id, dst, src, len, ch) and how much they copy."""
    return phrases.groupBy("text_id").agg(F.count("*").alias("phrases"), F.sum("len").alias("copied"), F.max("len").alias("longest"))


def points_in(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, x, y): points inside each box (box_id, x0, x1, y0, y1), met by cells of the box's narrower side."""
    cell = 64
    flat = F.col("x1") - F.col("x0") <= F.col("y1") - F.col("y0")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))

    def met(axis: str, some: DataFrame) -> DataFrame:
        left = points.withColumn("cell", F.floor(F.col(axis) / cell))
        right = some.withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"{axis}0") / cell), F.floor(F.col(f"{axis}1") / cell))))
        return left.join(right, "cell").where(inside).select("box_id", "x", "y")

    sound = boxes.where("x0 <= x1 and y0 <= y1")
    return met("x", sound.where(flat)).unionByName(met("y", sound.where(~flat)))
