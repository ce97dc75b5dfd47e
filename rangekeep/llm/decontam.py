"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Words are runs of other characters than ASCII marks, with A-Z lowered.  A window is WINDOW consecutive words of
an item, or all words of a shorter one.  Shingles are pairs of neighbouring words (single words for windows of
one word).  An exact window holds all its shingles, so its necessary prefix under the order of rarity is one shingle: the
rarest in the corpus.  A first pass over the documents counts the benchmark's shingles, which gives the order; windows with a
shingle that no document has are pruned.  The second pass joins the documents' shingles with the prefixes alone.  An occurrence
gives the offset at which a window would begin; those that leave no room for one are dropped.  The words there are looked up
among the distinct windows, which is exact containment, and these name their items.

So a document has at most WINDOW offsets of each length for an occurrence of a prefix, however many windows share it and however often
a text repeats itself.  Tables of the benchmark are broadcast up to BROADCAST_ROWS, which is counted first; beyond it the joins shuffle.
A null text has no words.  Documents repeated in full each get the same row; items with null ids count under
the id "".  An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NOT_WORD, ascii_lower, free_name, stage, without

WINDOW = 13
#: A document is contaminated if hits make up one word in so many, or more.
SHARE = 20
BROADCAST_ROWS = 500_000


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def pair_hashes(words: Column, n: Column) -> Column:
    """A hash for each pair of neighbouring words."""
    m = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), m), F.slice(words, F.lit(2), m), lambda a, b: F.xxhash64(a, b))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has no more than BROADCAST_ROWS rows, as counted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shingle_hashes(words: Column, n: Column, singles: bool) -> Column:
    """Hashes of a text's pairs; with singles, those of its single words follow at positions from n on."""
    pairs = pair_hashes(words, n)
    if not singles:
        return pairs
    ones = F.transform(words, lambda x: F.xxhash64(x, F.lit(None).cast("string")))
    gap = F.when(n > 0, F.array(F.lit(None).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(pairs, gap, ones)


def window_key(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ")))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, with_key: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with_key: and th, a hash of the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), split_words(F.col(item_text_col)).alias("iw"))
    items = items.withColumns({"len": F.size("iw"), "win": F.least(F.size("iw"), F.lit(window))}).filter("len > 0")
    cut = items.select("item_id", "win", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("win") + 1)).alias("s"), "iw")
    cut = cut.select("item_id", "win", F.slice("iw", F.col("s"), F.col("win")).alias("ww"))
    of_items = stage(spark, cut.select(window_key(F.col("ww")).alias("wid"), "item_id", "win", "ww").distinct(), "decontam-windows")
    windows = stage(spark, of_items.select("wid", "win", "ww").distinct(), "decontam-distinct")
    each = F.when(F.col("win") == 1, F.transform("ww", lambda x: F.xxhash64(x, F.lit(None).cast("string")))).otherwise(pair_hashes(F.col("ww"), F.col("win")))
    shingles = stage(spark, windows.select("wid", "win", F.posexplode(each).alias("q", "h")), "decontam-shingles")
    n_windows, n_shingles = of_items.count(), shingles.count()
    singles = not windows.filter("win = 1").isEmpty()

    # the first pass: how often the benchmark's shingles occur in the documents
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = source.select("doc_id", F.xxhash64("text").alias("th"), split_words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    hashes = shingle_hashes(F.col("w"), F.col("n"), singles)
    counts = keyed.select(F.explode(hashes).alias("h")).join(small(shingles.select("h").distinct(), n_shingles), "h", "left_semi")
    counts = stage(spark, counts.groupBy("h").agg(F.count("*").alias("c")), "decontam-counts")

    # each window's rarest shingle
    ranked = shingles.join(small(counts, n_shingles), "h", "left")
    rarest = ranked.groupBy("wid", "win").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "q")).alias("r")).filter("r.c > 0")
    prefixes = stage(spark, rarest.select("win", "r.h", "r.q").distinct(), "decontam-prefixes")

    # the second pass: where prefixes occur, if a window fits in the document there; and a first row for each document
    exploded = keyed.select("doc_id", "th", "n", F.posexplode_outer(hashes).alias("p", "h"))
    known = small(prefixes.select("h").distinct().withColumn("known", F.lit(True)), n_shingles)
    occ = exploded.join(known, "h", "left").filter("known or p = 0 or p is null")
    occ = occ.select("doc_id", "th", "n", (F.col("p") % F.greatest("n", F.lit(1))).alias("p"), "h", "known",
                     (F.coalesce("p", F.lit(0)) == 0).alias("first"))
    occ = stage(spark, occ, "decontam-occurrences")
    found = occ.filter("known").join(small(prefixes, n_shingles), "h").select("doc_id", "th", "n", (F.col("p") - F.col("q")).alias("d"), "win")
    found = found.filter("d >= 0 and d + win <= n").groupBy("doc_id", "th").agg(F.collect_set(F.struct("d", "win")).alias("found"))

    # exact verification: the words at these offsets, looked up among the windows
    texts = source.withColumn("th", F.xxhash64("text"))
    both = texts.join(found, texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["th"] == found["th"])).select(
        texts["doc_id"], texts["th"], "found", split_words(F.col("text")).alias("w"))
    at = both.select("doc_id", "th", F.explode(F.transform("found", lambda c: F.struct(
        c["d"].alias("a"), c["win"].alias("win"), F.slice("w", c["d"] + 1, c["win"]).alias("dw")))).alias("c")).select("doc_id", "th", "c.*")
    met = at.withColumn("wid", window_key(F.col("dw"))).join(small(windows.select("wid", "ww"), n_windows), "wid").filter(F.col("dw") == F.col("ww"))
    met = stage(spark, met.select("doc_id", "th", "wid", "a", (F.col("a") + F.col("win")).alias("b")).distinct(), "decontam-hits")
    spans = met.select("doc_id", "th", "a", "b").distinct()
    before = W.partitionBy("doc_id", "th").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.lit(0))))
    n_hit = spans.select("doc_id", "th", new.alias("new")).groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit"))
    ids = met.select("doc_id", "th", "wid").distinct().join(small(of_items.select("wid", "item_id").distinct(), n_windows), "wid").groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set("item_id")).alias("ids"))
    hit = n_hit.withColumns({"key": F.struct("doc_id", "th")}).join(ids.select(F.struct("doc_id", "th").alias("key"), "ids"), "key").select("doc_id", "th", "n_hit", "ids")

    every = occ.filter("first").select("doc_id", "th", "n")
    out = every.join(hit, every["doc_id"].eqNullSafe(hit["doc_id"]) & every["th"].eqNullSafe(hit["th"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        every["doc_id"], *([every["th"]] if with_key else []), F.col("n").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.greatest(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less the contaminated ones, whole and unchanged.  Rows are told apart by id and text, so texts that share an id
    are judged each for itself."""
    found = find(docs, benchmark, id_col, text_col, with_key=True).filter("contaminated").select("doc_id", "th")
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    return without(keyed, stage(docs.sparkSession, found, "decontam-contaminated"), id_col, key).drop(key)


#: The same as find() for the test tables.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS u(s) WHERE len(w) > 0),
dw AS (
  SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS t
  FROM d, (SELECT DISTINCT k FROM iw), unnest(range(1, len(w) + 1)) AS u(s) WHERE s + k - 1 <= len(w)),
h AS (SELECT r, s, k, item_id FROM dw JOIN iw USING (k, t)),
p AS (SELECT r, count(DISTINCT x) AS n_hit FROM h, unnest(range(s, s + k)) AS u(x) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""
