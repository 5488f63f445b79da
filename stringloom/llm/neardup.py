"""Near-duplicate groups: a multi-index Hamming join over MinHash signatures.

Every text becomes the set of its word shingles (64-bit hashes) and a signature of
CHUNKS * WIDTH minima, PART bits each; a pair of similarity s agrees in a part with
probability s. The Hamming distance of two signatures counts the parts that differ. By the
pigeonhole principle two signatures at a distance of at most 2 * CHUNKS - 1 have a chunk
with at most one error, so each signature is filed once per chunk and per allowed error
place (the chunk without that part): CHUNKS * WIDTH keys, and every such pair meets under
one of them. A pair of similarity 0.8 misses all keys with a probability below 2e-6.

Equal sets are one class, and only classes are filed. Groups of near copies are not
expanded into pairs: the members of a key are compared with the key's first member, links
are confirmed on the full sets, and components grow. Members of a key that all belong to one
component need no more comparison. Members of the other keys are compared across components
only, inside tasks: the distinct member sets of small keys as they are; of keys with over HOT
members each class once, in blocks of a bounded size, after a round with two more pivots for
each such key. What two classes are compared by is a finer sketch of BINS bins, fetched once
per class and block; keys and blocks carry ids only. Pairs that the sketch doesn't rule out
are confirmed on the full sets.

Links, components and sketches stay in tables; each round is written to the shared folder,
and a table is deleted once nothing reads it any more.

Defined cases: words are runs of other than ASCII white space, with A-Z lower-cased; a text
with fewer words than a shingle is one shingle; a null text or one without words has the
empty set, is linked with nothing and is its own component; rows are judged one by one, also
where a doc_id is repeated or null: rows with one doc_id and different texts may be in
different components; component_id is the smallest doc_id of the component's rows, null where
none of them has one; keep_one keeps exactly one row of each component (one with the smallest
doc_id) and every row with the empty set; other columns are kept where rows are filtered.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from .shared import forget, fresh, settle

CHUNKS, WIDTH = 10, 5
PARTS = CHUNKS * WIDTH

#: A finer sketch tells pairs apart: a shingle's hash falls in one of BINS bins, a bin's least
#: hash leaves a code from 1 to 254, an empty bin 0.
BINS = 1024

#: The bins' least hashes are a draw without replacement from the union of two sets. A pair is
#: ruled out if its equal codes are fewer, by so many standard deviations and one, than a pair
#: at the wanted similarity has: that loses fewer than one such pair in a million.
DEVIATIONS = 5.2

#: Members of a key up to which it is compared by itself; classes of a block beyond that.
HOT, BLOCK = 256, 1024

#: Ids (of 8 bytes) up to this number are broadcast to pick texts; beyond, a shuffle join does it.
BROADCAST_IDS = 1_000_000

_SEEDS = np.random.default_rng(11).integers(1, 2**63, PARTS + PARTS + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS, _TAGS, _POSITIONS = _SEEDS[:PARTS], _SEEDS[PARTS : 2 * PARTS], _SEEDS[2 * PARTS :]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of k words; of the whole text, if it has fewer."""
    if not len(words):
        return words
    size = min(k, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size))
    for j in range(size):
        total = textscan.mix(total * _POSITIONS[j % 8] + words[j : len(words) - size + 1 + j])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """PARTS parts of 16 bits."""
    least = np.empty(PARTS, np.uint64)
    spread = hashes ^ (hashes >> np.uint64(31))
    for i in range(PARTS):
        least[i] = (spread * _MULTIPLIERS[i]).min()
    return (textscan.mix(least) >> np.uint64(48)).astype(np.uint16)


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """BINS codes of one byte, from sorted hashes."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(hashes >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out[bins.astype(np.int64)] = (hashes[first] >> np.uint64(16)) % np.uint64(254) + np.uint64(1)
    return out


def enough(bins: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Equal codes that a pair at the wanted similarity has: bins that it fills, and both sets' sizes together."""
    share = percent / 100
    union = np.maximum(sizes / (1 + share), bins)
    left_out = (union - bins) / np.maximum(union - 1, 1)
    return share * bins - DEVIATIONS * np.sqrt(share * (1 - share) * bins * left_out) - 1


def alike(one: np.ndarray, n: int, many: np.ndarray, filled: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of many sketches (with so many filled bins, of sets of these sizes) may reach the similarity with one."""
    bins = np.maximum(filled, np.count_nonzero(one))
    first = percent / 100 * bins - DEVIATIONS * np.sqrt(percent / 100 * (1 - percent / 100) * bins) - 1
    equal = np.count_nonzero(many == np.where(one, one, 255), axis=1)
    ok = np.flatnonzero((equal >= first) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
    union = np.count_nonzero(many[ok] | one, axis=1)
    return ok[equal[ok] >= enough(union, sizes[ok] + n, percent)]


def identity(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, the same in any order."""
    with np.errstate(over="ignore"):
        total = np.uint64(len(hashes)) * np.uint64(_BASE) + textscan.mix(hashes).sum(dtype=np.uint64)
        return int(textscan.mix(np.array([total ^ (textscan.mix(hashes * np.uint64(_BASE)).sum(dtype=np.uint64) >> np.uint64(1))], np.uint64)).view(np.int64)[0])


_BASE = 0x9E3779B97F4A7C15


def keys(signatures: np.ndarray) -> np.ndarray:
    """For signatures (n x PARTS), the keys (n x PARTS): place i * WIDTH + j is chunk i without part j."""
    parts = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(parts), CHUNKS, WIDTH), np.uint64)
    for j in range(WIDTH):
        packed = np.zeros((len(parts), CHUNKS), np.uint64)
        for p in range(WIDTH):
            if p != j:
                packed = (packed << np.uint64(16)) | parts[:, :, p]
        out[:, :, j] = packed
    return textscan.mix(out.reshape(-1, PARTS) ^ _TAGS[None, :]).view(np.int64)


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row; rows with equal doc_id and text have one name."""
    return F.xxhash64(doc_id, text)


def sketch(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, n, cls, sig): size, name and signature of each text's set; cls is null for the empty set."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sizes, names, sigs = np.zeros(n, np.int64), [None] * n, [None] * n
            for i, words in textscan.rows(batch.column("text"), textscan.SPACED):
                if len(words):
                    hashes = shingles(words, k)
                    sizes[i], names[i], sigs[i] = len(hashes), identity(hashes), signature(hashes).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes), pa.array(names, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "row", "n", "cls", "sig"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id).cast("long"), F.col(text)).alias("row"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, row long, n long, cls long, sig binary")


def file_keys(classes: DataFrame) -> DataFrame:
    """(key, place, cls): each class under all its keys."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                own = keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, PARTS))
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.tile(np.arange(PARTS, dtype=np.int16), len(own))), pa.array(np.repeat(batch.column("cls").to_numpy(), PARTS))], names=["key", "place", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, place short, cls long")


def texts_of(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, text) of the rows whose names are in `rows` (row)."""
    few = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    return docs.select(row_key(F.col(doc_id).cast("long"), F.col(text)).alias("row"), F.col(text).alias("text")).join(few, "row", "left_semi")


def refine(classes: DataFrame, docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(cls, row, n, fine): sizes and fine sketches of some classes (cls, row), from their representatives' texts."""

    def run(batches):
        for batch in batches:
            rows = batch.column("row").to_pylist()
            got = [(rows[i], shingles(words, k)) for i, words in textscan.rows(batch.column("text"), textscan.SPACED)]
            own = [(identity(hashes), row, len(hashes), fine_sketch(hashes).tobytes()) for row, hashes in got if len(hashes)]
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], kind) for i, kind in enumerate(kinds)], names=["cls", "row", "n", "fine"])

    found = texts_of(docs, classes.select("row"), doc_id, text).mapInArrow(run, "cls long, row long, n long, fine binary")
    return found.dropDuplicates(["cls"])


def near(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that the fine sketches allow, with their representatives' rows."""
    one, two = (fine.select(F.col("cls").alias(x), F.col("row").alias(f"row_{x}"), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("fine_a", "fine_b"))
            equal, both = np.count_nonzero((x == y) & (x > 0), axis=1), np.count_nonzero(x | y, axis=1)
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            close = (equal >= enough(both, n + m, percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield batch.select(["a", "row_a", "b", "row_b"]).filter(pa.array(close))

    return pairs.join(one, "a").join(two, "b").select("a", "row_a", "n_a", "fine_a", "b", "row_b", "n_b", "fine_b").mapInArrow(run, "a long, row_a long, b long, row_b long")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Of pairs (a, row_a, b, row_b) the links (a, b): 100 * intersection >= percent * union, on the full sets."""
    rows = settle(pairs.select(F.col("row_a").alias("row")).union(pairs.select(F.col("row_b"))).distinct(), "pair-rows")
    texts = settle(texts_of(docs, rows, doc_id, text).dropDuplicates(["row"]), "pair-texts")
    one, two = (texts.select(F.col("row").alias(f"row_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(one, "row_a").join(two, "row_b")

    def run(batches):
        @lru_cache(maxsize=32)
        def of(said: str) -> tuple[int, np.ndarray]:
            found = [shingles(w, k) for _, w in textscan.rows(pa.array([said]), textscan.SPACED)]
            hashes = found[0] if found else np.empty(0, np.uint64)
            return identity(hashes), hashes

        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (a, x, b, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b")))):
                (name_x, own), (name_y, other) = of(x), of(y)
                if name_x == a and name_y == b:
                    common = _common(own, other)
                    linked[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    links = settle(both.select("a", "text_a", "b", "text_b").mapInArrow(run, "a long, b long").distinct(), "links")
    forget(rows, texts)
    return links


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches.

    Each round takes the smallest label among the neighbours and then the label's own label,
    until nothing changes.
    """
    edges = settle(links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*").distinct(), "edges")
    labels = settle(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("around"))
        lower = labels.join(around, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "around").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = settle(lower.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), "labels")
        forget(labels)
        labels = moved
        if not moved.where("label <> old").limit(1).count():
            forget(edges)
            return labels


def _grow(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links; nodes without a label stand for themselves."""
    if labels is None:
        return components(links).select("node", "label")
    lifted = _with_label(_with_label(links, labels, "a"), labels, "b").where(F.col("a_label") != F.col("b_label"))
    roots = components(lifted.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))).select(F.col("node").alias("root"), F.col("label").alias("top"))
    known = labels.join(roots, F.col("label") == F.col("root"), "left").select("node", F.coalesce("top", "label").alias("label"))
    new = roots.join(labels.select("node"), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("top").alias("label"))
    return settle(known.unionByName(new), "labels")


def _with_label(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(own, F.col(column) == F.col("_node"), "left").withColumn(f"{column}_label", F.coalesce("_label", column)).drop("_node", "_label")


def _open(live: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, cls, cls_label, m) of the keys that hold several components; m: how many the key has."""
    own = _with_label(live.select("key", "cls"), labels, "cls")
    mixed = own.groupBy("key").agg(F.min("cls_label").alias("least"), F.max("cls_label").alias("most"), F.min("cls").alias("first"), F.count("*").alias("m")).where("least < most").select("key", "first", "m")
    return own.join(mixed, "key")


def _pivot_pairs(members: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """Pairs of each member with its key's pivots, where these are in other components."""

    def draw(seed: int) -> Column:
        return F.min_by(F.struct("cls", "cls_label"), F.xxhash64("cls", "key", F.lit(seed)))

    drawn = members.groupBy("key").agg(*(draw(s).alias(f"p{s}") for s in seeds)).select("key", F.explode(F.array(*(f"p{s}" for s in seeds))).alias("p"))
    pairs = members.join(drawn, "key").where(F.col("cls_label") != F.col("p.cls_label"))
    return pairs.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """(home, i, j, part, cls, cls_label): the blocks to compare, i and j in home; part is the one that the class is of.

    A home is a distinct member set of small keys, in one block, or the classes that large
    keys connect, each class once, dealt over blocks of about BLOCK.
    """
    sets = members.where(F.col("m") <= HOT).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cls", "cls_label"))).alias("all"))
    named = sets.select(F.xxhash64("all").alias("home"), "all").dropDuplicates(["home"])
    none = F.lit(0).cast("long")
    small = named.select("home", none.alias("i"), none.alias("j"), none.alias("part"), F.explode("all").alias("x")).select("home", "i", "j", "part", "x.cls", "x.cls_label")
    large = settle(members.where(F.col("m") > HOT).select("first", "cls", "cls_label").distinct(), "hot-members")
    homes = components(large.select(F.col("first").alias("a"), F.col("cls").alias("b")).where("a <> b")).select(F.col("node").alias("cls"), F.col("label").alias("home"))
    each = large.select("cls", "cls_label").distinct().join(homes, "cls")
    sized = settle(each.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("of")), "hot-sizes")
    dealt = each.join(sized, "home").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("of")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    return small.unionByName(other.select("home", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls", "cls_label"))


def _cross_pairs(members: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """(a, row_a, b, row_b): pairs that meet under a key, in different components, that the fine sketches allow."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(members).join(fine, "cls").select("home", "i", "j", "part", "cls", "cls_label", "row", "n", "fine")
    names = ["home", "i", "j"]

    def compare(block: pa.Table) -> pa.RecordBatch:
        part, cls, label, row, n = (block.column(c).to_numpy() for c in ("part", "cls", "cls_label", "row", "n"))
        # members of one component stand together, the largest first: each is compared with what follows its component
        _, at, sizes = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort((cls, label, -sizes[at]))
        part, cls, label, row, n = part[order], cls[order], label[order], row[order], n[order]
        codes = np.frombuffer(b"".join(block.column("fine").to_pylist()), np.uint8).reshape(-1, BINS)[order]
        filled = np.count_nonzero(codes, axis=1)
        ends = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, len(label))
        across = part.min() != part.max()
        xs, ys = [], []
        for x in range(int(ends[-2]) if len(ends) > 1 else 0):
            end = int(ends[np.searchsorted(ends, x, "right")])
            ok = end + alike(codes[x], n[x], codes[end:], filled[end:], n[end:], percent)
            ys.append(ok[part[ok] != part[x]] if across else ok)
            xs.append(np.full(len(ys[-1]), x))
        x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
        x, y = np.where(cls[x] < cls[y], x, y), np.where(cls[x] < cls[y], y, x)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (cls[x], row[x], cls[y], row[y])], names=["a", "row_a", "b", "row_b"])

    def run(batches):
        wait, last = [], None
        for batch in batches:
            homes, i, j = (batch.column(c).to_numpy() for c in names)
            cuts = [0, *(np.flatnonzero((homes[1:] != homes[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                here = homes[a], i[a], j[a]
                if here != last and wait:
                    yield compare(pa.Table.from_batches(wait))
                    wait = []
                last = here
                wait.append(batch.slice(a, b - a))
        if wait:
            yield compare(pa.Table.from_batches(wait))

    dealt = blocks.repartition(parts, *names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "a long, row_a long, b long, row_b long").distinct()


def _grouped(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (cls, home, component_id) of all classes; home names the component."""
    sketched = settle(sketch(docs, k, doc_id, text), "sketches")
    classes = settle(sketched.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.min("sig").alias("sig")), "classes")
    members = file_keys(classes)
    shared = members.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("most")).where("pivot < most").select("key", "pivot")
    live = settle(members.join(shared, "key").select("key", "pivot", "cls"), "keys")
    apart = settle(live.select("cls").distinct().join(classes.select("cls", "row"), "cls"), "apart")
    fine = settle(refine(apart, docs, k, doc_id, text), "fine-sketches")

    def link(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs, "pairs")
        links = confirm(pairs, docs, k, percent, doc_id, text)
        forget(pairs)
        return links

    star = live.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()
    labels = _grow(None, link(near(star, fine, percent)))
    hot = settle(_open(live, labels).where(F.col("m") > HOT), "open")
    labels = _grow(labels, link(near(_pivot_pairs(hot, (1, 2)), fine, percent)))
    members = settle(_open(live, labels), "open")
    labels = _grow(labels, link(_cross_pairs(members, fine, percent)))

    named = _with_label(classes.select("cls", "first_id"), labels, "cls")
    smallest = named.groupBy("cls_label").agg(F.min("first_id").alias("component_id"))
    homes = settle(named.join(smallest, "cls_label").select("cls", F.col("cls_label").alias("home"), "component_id"), "homes")
    forget(classes, live, apart, fine, hot, members)
    return sketched, homes


def groups(docs: DataFrame, *, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row per document.

    component_id is the smallest doc_id that the document reaches over links, itself
    included; kept says that it is its own (all rows with that doc_id and text say so).
    """
    sketched, homes = _grouped(docs, k, percent, doc_id, text)
    out = sketched.select("doc_id", "n", "cls").join(homes.select("cls", "component_id"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group, as they were."""
    sketched, homes = _grouped(docs, k, percent, doc_id, text)
    rows = sketched.where(F.col("cls").isNotNull()).join(homes, "cls")
    first = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row")))
    chosen = rows.groupBy("home").agg(first.alias("chosen"))
    judged = settle(rows.join(chosen, "home").groupBy("doc_id", "row").agg(F.min(F.col("row") == F.col("chosen")).alias("stays"), F.count("*").alias("times")), "judged")
    its_id, its_row = fresh(docs, "judged_id"), fresh(docs, "judged_row")
    own, name = F.col(doc_id).cast("long"), row_key(F.col(doc_id).cast("long"), F.col(text))
    same = own.eqNullSafe(F.col(its_id)) & (name == F.col(its_row))
    named = judged.select(F.col("doc_id").alias(its_id), F.col("row").alias(its_row), "stays", "times")
    gone = named.where(~F.col("stays") | (F.col("times") > 1)).select(its_id, its_row)
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    out = docs.join(few, same, "left_anti")
    again = named.where(F.col("stays") & (F.col("times") > 1)).select(its_id, its_row)
    if not again.limit(1).count():
        return out
    # a row that stays and is repeated, doc_id and text alike: any one of its copies
    copies = docs.join(again, same, "left_semi")
    once = copies.groupBy(own.alias(its_id), name.alias(its_row)).agg(F.first(F.struct(*docs.columns)).alias("copy"))
    return out.unionByName(once.select("copy.*"))
