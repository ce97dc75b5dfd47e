"""Near-duplicate detection by Order MinHash, verified by banded alignment.

Texts are word sequences (the word rule of `common`); shingles are five words, labelled with their occurrence
number.  For each of BANDS hash functions a sketch keeps the PICK smallest labelled shingles in text order, so
equal entries mean the same shingles in the same order.  Equal texts are collapsed first.  Two texts are candidates if they
share MIN_SHARED entries, and a candidate is verified: labelled shingles are aligned in order, within the band of offsets that
the threshold leaves, and matched / (all - matched) must reach THRESHOLD.  Classes are the connected components of the links.

Texts of at most SHORT shingles are also found by a prefix-filtered join: they and those that they can reach have an entry for each
of their n - ceil(threshold n) + 1 rarest labelled shingles, and one such entry shared makes a candidate; so their links are exact.
Expected recall of a pair of longer texts at similarity s is 1 - (1-p)^B - B p (1-p)^(B-1), p = s^PICK: over 0.9999 at 0.8.

Hot buckets.  In a bucket (band, entry) of at most PAIRS_UP_TO texts all pairs are candidates.  In a larger one each text first meets the
bucket's centres (those whose entries are the commonest, and one by a hash), which joins most texts of a group; that only saves
work.  Then every large bucket that holds more than one class by then is opened: its texts outside its largest class are attached to
that class, and all texts attached to a class meet each other and all its members, whatever their number.  Such
meetings are dealt to tasks in blocks of BLOCK_TEXTS texts and BLOCK_WORDS words, about; in a block, shared shingles are counted for all pairs at once,
and pairs that can reach the threshold and are not joined yet are aligned.  So classes are those of all candidates, in groups of any
size, and no task holds more than two blocks.  The worst case, many texts of one bucket that are no links, compares them all.

Null texts count as empty; texts without words are linked only to equal texts.  Shorter texts than five words are one
shingle.  Rows with null ids take part; a class's id is its least non-null id.  Rows repeated in full are copies.
"""

from bisect import bisect_left
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, passing, stage, without
from .decontam import split_words

SHINGLE = 5
BANDS = 32
PICK = 5
THRESHOLD = 0.8
MIN_SHARED = 2
PAIRS_UP_TO = 24
#: Shingles up to which chance would lose pairs: such texts are found exactly.
SHORT = 56
#: Texts and words, about, of a block of texts that meet another block.
BLOCK_TEXTS, BLOCK_WORDS = 512, 1 << 17
#: Shingles that are counted at once in a block.
COLUMNS = 4096
#: Ids up to which a list of documents is broadcast, as counted.
BROADCAST_ROWS = 100_000

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
SEEDS = np.random.default_rng(5).integers(1, 1 << 63, size=BANDS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return x ^ (x >> np.uint64(29))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """A hash for each shingle of a text, which takes in how often it has occurred before."""
    w = words.astype(np.uint64, copy=False)
    n = len(w)
    if n == 0:
        return w
    size = min(n, SHINGLE)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = mixed(h * MIX + w[i : n - size + 1 + i])
    order = np.argsort(h, kind="stable")
    run = h[order]
    new = np.ones(len(h), bool)
    new[1:] = run[1:] != run[:-1]
    starts = np.flatnonzero(new)
    nth = np.empty(len(h), np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return mixed(h + nth * MIX)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each band, a hash of the PICK smallest labelled shingles in text order."""
    n = len(shingles)
    if n == 0:
        return np.empty(0, np.int64)
    out = np.zeros(BANDS, np.uint64)
    step = max(1, (1 << 20) // n)
    for at in range(0, BANDS, step):
        seeds = SEEDS[at : at + step, None]
        if n > PICK:
            keys = mixed((shingles[None, :] ^ seeds) * MIX)
            index = np.sort(np.argpartition(keys, PICK - 1, axis=1)[:, :PICK], axis=1)
            picked = shingles[index]
        else:
            picked = np.broadcast_to(shingles, (len(seeds), n))
        h = np.broadcast_to(seeds, (len(seeds), 1))[:, 0].copy()
        for i in range(picked.shape[1]):
            h = mixed(h * MIX + picked[:, i])
        out[at : at + step] = h
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of two texts' labelled shingles that align in order.  Offsets are held within the band beyond which
    the threshold cannot be reached; below the threshold the value is a lower bound."""
    na, nb = len(a), len(b)
    if min(na, nb) == 0 or min(na, nb) < threshold * max(na, nb):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (1 / threshold - 1) * min(na, nb) + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < threshold * max(na, nb):
        return len(i) / (na + nb - len(i))
    j = j[np.argsort(i)]
    if not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    else:
        m = len(j)
    return m / (na + nb - m)


def word_hashes(text: Column) -> Column:
    return F.transform(split_words(text), lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in zip(offsets, offsets[1:]):
        yield values[a:b]


def _as_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _sketch_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Sketches, and the labelled shingles themselves of texts that have so many at most."""
    for column, most in batches:
        each = [labelled_shingles(w) for w in _lists(column)]
        short = [x.view(np.int64) if len(x) <= m else np.empty(0, np.int64) for x, m in zip(each, most.to_pylist())]
        yield pa.StructArray.from_arrays([_as_lists([sketch(x) for x in each]), _as_lists(short)], names=["sketch", "shingles"])


def prefixes(sketches: DataFrame, threshold: float) -> DataFrame:
    """(k, b): entries for the rarest shingles of short texts, so many that two texts at the threshold share one.  What occurs
    once is left out, as nothing shares it."""
    each = sketches.filter(F.size("shingles") > 0).select("k", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("c"))
    order = F.array_sort(F.collect_list(F.struct("c", "s")))
    first = each.join(counts, "s").groupBy("k", "n").agg(order.alias("all")).select(
        "k", F.explode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("p"))
    return first.filter("p.c > 1").select("k", F.xxhash64("p.s", F.lit("short")).alias("b"))


def _similar_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([similarity(labelled_shingles(x), labelled_shingles(y)) for x, y in zip(_lists(a), _lists(b))], pa.float64())


def small_pairs(held: DataFrame, shared: int) -> DataFrame:
    """All pairs of each small bucket."""
    small = held.filter(F.col("n") <= PAIRS_UP_TO).groupBy("b").agg(F.collect_list("k").alias("ks"))
    pairs = small.select(F.explode("ks").alias("x"), "ks").select("x", F.explode("ks").alias("y")).filter("x < y")
    return pairs.select("x", "y", F.lit(shared).alias("shared"))


def ranked(large: DataFrame) -> DataFrame:
    """(b, k, common): texts whose entries are the commonest are nearest to what a group has in common."""
    return large.join(large.groupBy("k").agg(F.sum("n").alias("common")), "k").select("b", "k", "common")


def centres(large: DataFrame) -> DataFrame:
    """(b, cs): up to three texts of each large bucket, the same ones over many buckets where they can be."""
    orders = [F.struct(-F.col("common"), F.col("k")), F.struct(-F.floor(2 * F.log2("common")), F.xxhash64("k"), F.col("k")),
              F.struct(F.xxhash64("k", F.lit(1)), F.col("k"))]
    first = ranked(large).groupBy("b").agg(*[F.min(o).alias(f"c{s}") for s, o in enumerate(orders)])
    return first.select("b", F.array_distinct(F.array(*[F.col(f"c{s}.k") for s in range(len(orders))])).alias("cs"))


def with_centres(members: DataFrame, of: DataFrame) -> DataFrame:
    """Members with the centres (b, cs) of their buckets; a text meets a centre once, however many buckets hold both."""
    met = members.join(of, "b").groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("cs"))).alias("cs"))
    pairs = met.select("k", F.explode("cs").alias("c")).filter("k != c")
    return pairs.select(F.least("k", "c").alias("x"), F.greatest("k", "c").alias("y"), F.lit(MIN_SHARED).alias("shared"))


def enough(found: list[DataFrame]) -> DataFrame:
    """Distinct pairs (a, b) that share MIN_SHARED entries; a pair with a centre counts as such."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    shared = every.groupBy("x", "y").agg(F.sum("shared").alias("n")).filter(F.col("n") >= MIN_SHARED)
    return shared.select(F.col("x").alias("a"), F.col("y").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(k, root) for each end of the edges (a, b): the least k of its component.  Labels go to neighbours and
    then along the labels themselves, so rounds grow with the logarithm of the longest path."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = stage(spark, both, "dedup-edges")
    labels = stage(spark, both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("k"), "root"), "dedup-labels")
    while True:
        around = both.join(labels, both["b"] == labels["k"]).groupBy("a").agg(F.min("root").alias("least"))
        near = labels.join(around, labels["k"] == around["a"]).select("k", "root", F.least("root", "least").alias("new"))
        jump = labels.select(F.col("k").alias("new"), F.col("root").alias("next"))
        moved = near.join(jump, "new", "left").select("k", "root", F.least("new", F.coalesce("next", "new")).alias("to"))
        moved = stage(spark, moved, "dedup-labels")
        labels = moved.select("k", F.col("to").alias("root"))
        if moved.filter("root != to").isEmpty():
            return labels


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each text of left shares with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    values = [np.concatenate([np.empty(0, np.uint64), *texts]) for texts in (left, right)]
    both = np.intersect1d(*values)
    spots = []
    for texts, every in zip((left, right), values):
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.searchsorted(both, every)
        known = at < len(both)
        known[known] = both[at[known]] == every[known]
        order = np.argsort(at[known], kind="stable")
        spots.append((row[known][order], at[known][order]))
    for a in range(0, len(both), COLUMNS):
        dense = []
        for texts, (row, at) in zip((left, right), spots):
            lo, hi = np.searchsorted(at, (a, a + COLUMNS))
            d = np.zeros((len(texts), min(COLUMNS, len(both) - a)), np.float32)
            d[row[lo:hi], at[lo:hi] - a] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    return out


def block_links(left: pa.Table, right: pa.Table, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links that join the different roots of two blocks of texts (k, root, w), as pairs of roots: all but those between
    roots that other links of the blocks join already."""
    sides = []
    for t in (left, right):
        texts = [labelled_shingles(w) for c in t["w"].chunks for w in _lists(c)]
        sides.append((texts, t["root"].to_pylist(), np.array([len(x) for x in texts])))
    (xs, rx, nx), (ys, ry, ny) = sides
    number = {r: i for i, r in enumerate(dict.fromkeys([*rx, *ry]))}
    of = np.arange(len(number))
    ix, iy = (np.array([number[r] for r in rs], np.int64) for rs in (rx, ry))
    shared = shared_shingles(xs, ys)
    near = (shared * (1 + threshold) >= threshold * (nx[:, None] + ny[None, :]) - 1e-6) & (ix[:, None] != iy[None, :])
    i, j = np.nonzero(near)
    out, order = [], np.argsort(-shared[i, j] / (nx[i] + ny[j]), kind="stable")
    for p, q in zip(i[order].tolist(), j[order].tolist()):
        a, b = of[ix[p]], of[iy[q]]
        if a != b and similarity(xs[p], ys[q], threshold) >= threshold:
            out.append((min(rx[p], ry[q]), max(rx[p], ry[q])))
            of[of == b] = a
    return out


def crossing_links(large: DataFrame, words: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Links between classes (a, b: roots) that share a large bucket: all that are needed to join what candidates join.  See above."""
    spark = large.sparkSession
    members = stage(spark, large.select("k", "b").join(roots, "k", "left").select("k", "b", F.coalesce("root", "k").alias("root")), "dedup-members")
    sizes = members.groupBy("b", "root").agg(F.count("*").alias("n"))
    of = sizes.groupBy("b").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    of = stage(spark, of, "dedup-open")
    outer = members.alias("m").join(of.alias("o"), (F.col("m.b") == F.col("o.b")) & (F.col("root") != F.col("main"))).select("k", "root", "main").distinct()
    outer = stage(spark, outer, "dedup-outer")
    mains = outer.select("main").distinct()
    inner = roots.join(mains, F.col("root") == F.col("main"), "left_semi").select("k", "root", F.col("root").alias("main"))
    alone = mains.join(roots.select(F.col("k").alias("main")), "main", "left_anti")  # a class of one text
    inner = inner.unionByName(alone.select(F.col("main").alias("k"), F.col("main").alias("root"), "main"))
    every = outer.withColumn("out", F.lit(True)).unionByName(inner.withColumn("out", F.lit(False))).join(words, "k")
    every = stage(spark, every, "dedup-meeting")

    def blocks(out: bool):
        some = F.when(F.col("out") == F.lit(out), 1)
        return F.greatest(F.ceil(F.count(some) / BLOCK_TEXTS), F.ceil(F.coalesce(F.sum(some * F.size("w")), F.lit(0)) / BLOCK_WORDS)).cast("int")

    # blocks of a class's members are 0..inner-1, those of texts attached to it the next ones; the latter meet all before and themselves
    counts = stage(spark, every.groupBy("main").agg(blocks(True).alias("outer"), blocks(False).alias("inner")), "dedup-blocks")
    every = every.join(counts, "main").withColumn("s", F.when(F.col("out"), F.col("inner") + F.pmod(F.xxhash64("k"), F.col("outer"))).otherwise(F.pmod(F.xxhash64("k"), F.col("inner"))).cast("int"))
    first, last = F.col("inner"), F.col("inner") + F.col("outer") - 1
    left = every.filter("out").select("main", F.col("s").alias("i"), F.explode(F.sequence(F.lit(0), F.col("s"))).alias("j"), "root", "w")
    right = every.select("main", F.explode(F.sequence(F.greatest(F.col("s"), first), last)).alias("i"), F.col("s").alias("j"), "root", "w")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        found = block_links(x, y, threshold) if len(x) and len(y) else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    keys = ["main", "i", "j"]
    return stage(spark, left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "a binary, b binary").distinct(), "dedup-crossing")


def links(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) between different texts, by their keys (md5 of the text): all of those in small buckets and with
    centres; and the classes (k, root) that they and the links across large buckets make."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.unhex(F.md5("text")))
    make = F.arrow_udf(_sketch_batches, "struct<sketch:array<bigint>,shingles:array<bigint>>").asNondeterministic()
    most = F.lit(int(SHORT / threshold + 1e-9))
    each = stage(spark, texts.select("k", make(word_hashes(F.col("text")), most).alias("made")).select("k", "made.*"), "dedup-sketches")
    sketches = stage(spark, each.filter(F.size("sketch") > 0).dropDuplicates(["k"]), "dedup-distinct")
    entries = sketches.select("k", F.explode("sketch").alias("b")).withColumn("short", F.lit(False))
    entries = entries.unionByName(prefixes(sketches, threshold).withColumn("short", F.lit(True)))
    counts = stage(spark, entries.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1"), "dedup-counts")
    held = stage(spark, entries.join(counts, "b"), "dedup-buckets")
    ends = held.select("k").distinct()
    few = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(ends) if few else ends, "k", "left_semi").dropDuplicates(["k"])
    words = stage(spark, wanted.select("k", word_hashes(F.col("text")).alias("w")), "dedup-words")
    measure = F.arrow_udf(_similar_batches, "double").asNondeterministic()
    large = held.filter(F.col("n") > PAIRS_UP_TO)
    crowded = not large.isEmpty()
    pairs = [small_pairs(held.filter("not short"), 1), small_pairs(held.filter("short"), MIN_SHARED)]
    if crowded:
        pairs.append(with_centres(large, stage(spark, centres(large), "dedup-centres")))
    met = stage(spark, enough(pairs), "dedup-pairs").join(words.select(F.col("k").alias("b"), F.col("w").alias("wb")), "b").join(
        words.select(F.col("k").alias("a"), F.col("w").alias("wa")), "a")
    found = stage(spark, met.select("a", "b", measure("wa", "wb").alias("similarity")).filter(F.col("similarity") >= threshold), "dedup-links")
    roots = components(found)
    if crowded:
        over = components(crossing_links(large, words, roots, threshold)).toDF("old", "new")
        # a text without links yet has no root, so it comes with the roots that are joined
        roots = roots.union(over.select(F.col("old").alias("k"), F.col("old").alias("root")).join(roots.select("k"), "k", "left_anti"))
        roots = roots.join(over, roots["root"] == over["old"], "left").select("k", F.coalesce("new", "root").alias("root"))
        roots = stage(spark, roots, "dedup-roots")
    return found, roots


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def rows_with_roots(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(doc_id, k, r) for each row of docs: the text's key, and the root of its class."""
    spark = docs.sparkSession
    with passing(spark):
        roots = links(docs, text_col, threshold)[1].withColumnRenamed("root", "r")
        rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("k"))
        few = roots.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(roots) if few else roots, "k", "left").select("doc_id", "k", F.coalesce("r", "k").alias("r"))
        return stage(spark, rows, "dedup-rows", keep=True)


def with_classes(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """rows with aggregates over their classes of two rows and more; nulls for classes of one.  The classes are counted before they are
    sent to all executors."""
    sums = stage(rows.sparkSession, rows.groupBy("r").agg(F.count("*").alias("class_size"), *aggregates).filter("class_size > 1"), "dedup-sizes")
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(sums) if few else sums, "r", "left")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (least id of the class), class_size (rows)."""
    rows = with_classes(rows_with_roots(docs, id_col, text_col, threshold), F.min("doc_id").alias("class_id"))
    return rows.select("doc_id", F.when(F.col("class_size") > 1, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                       F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs less all but one of each class: one with the class's id stays, whole and unchanged.  Rows are told apart by
    id and text, so different texts that share an id are judged each for itself; of rows that repeat both, one stays."""
    spark = docs.sparkSession
    rows = rows_with_roots(docs, id_col, text_col, threshold)
    rows = with_classes(rows, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first")).filter("class_size > 1")
    rows = stage(spark, rows.select("doc_id", "k", ((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("k") == F.col("first.k"))).alias("stays")), "dedup-lost")
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    kept = without(keyed, rows.filter("not stays").select("doc_id", "k"), id_col, key)
    twice = stage(spark, rows.filter("stays").groupBy("doc_id", "k").count().filter("count > 1").select("doc_id", "k"), "dedup-twice")
    if not twice.isEmpty():
        once = without(kept, twice, id_col, key, keep=True).dropDuplicates([id_col, key])
        kept = without(kept, twice, id_col, key).unionByName(once)
    return kept.drop(key)
