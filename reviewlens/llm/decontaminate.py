"""Benchmark decontamination with DataFrame functions only.

A benchmark item leaks into a document when some window of the document, as
long as the item, reaches ``percent`` weighted Jaccard similarity on five-word
shingles (a shingle weighs as often as it occurs).

1. Anchors: a window can only be similar if it shares a shingle with the item,
   so document shingles are joined with the items' shingles; an equal shingle
   fixes where the item-sized window starts (one word of slack both ways).  With
   words inserted inside or parts moved, the best window can start between two
   anchored starts, so every start between neighbours under two item lengths
   apart is taken too (a window whose shingles imply no start below its own, or
   none above, loses nothing when moved to the nearest one).  Windows that hold
   fewer shared shingles than the threshold needs are dropped.
2. Every other such window gets a 64-bit SimHash of its shingles.
3. Multi-index Hamming join: fingerprints are cut into ``BLOCKS`` blocks, and
   the item side lists all values within ``radius // BLOCKS`` bits of each of
   its blocks; by the pigeonhole principle every pair within ``radius`` bits
   meets in a block.
4. Pairs within the radius are verified by exact weighted similarity.

Benchmark tables are joined, never collected; Spark broadcasts them while its
size estimate allows and shuffles them beyond.

Defined results: null texts have no words; items under five words have no
shingle and match nothing; a document shorter than an item is one window;
rows that repeat a doc_id are reported separately, rows that repeat an item_id
count as separate items with that id; null ids are kept; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import SHINGLE, WORD, small, texts, written

BLOCKS, BLOCK_BITS = 8, 8
RADIUS = 23
SLACK = 1


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """64-bit hash of every ``k``-word run (lower-cased), in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(
            *(F.get(h, i + t) for t in range(k))))).otherwise(F.array().cast("array<bigint>")))


def simhash(grams: Column) -> Column:
    """64-bit SimHash: each bit is the majority over the shingles' hashes."""
    def bit(acc, b):
        ones = F.aggregate(grams, F.lit(0), lambda n, h: n + F.call_function(
            "shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(grams), acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def _blocks(fingerprint: Column) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(
        fingerprint, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        .alias("value")) for b in range(BLOCKS)))


def _flips(bits: int) -> list[int]:
    """Masks with at most ``bits`` of the block's bits set."""
    return [sum(1 << i for i in c) for n in range(bits + 1)
            for c in itertools.combinations(range(BLOCK_BITS), n)]


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, grams, n, print) of every item with five words or more."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(
        "item_id", "text").alias("item"), shingles(F.col("text")).alias("grams")).filter(
            "size(grams) > 0").dropDuplicates(["item"])
    return items.select("item", "item_id", "grams", F.size("grams").alias("n"),
                        simhash(F.col("grams")).alias("print"))


def _starts(w: Column, last: Column, percent: int) -> Column:
    """Structs (start, anchored) of the windows of ``w`` that hold enough shared shingles.

    ``last`` is the last start of an item-sized window (negative in a shorter document).
    """
    def clamp(starts):
        return F.array_distinct(F.transform(starts, lambda s: F.greatest(F.lit(0), F.least(s, last))))

    def between(i):
        low, high = F.get(w["starts"], i), F.get(w["starts"], i + 1)
        return F.when((high - low > 2 * SLACK + 1) & (high - low < 2 * w["n"]), F.sequence(
            low + SLACK + 1, high - SLACK - 1)).otherwise(F.array().cast("array<int>"))

    def enough(held, size):
        return held * (100 + percent) >= percent * (size + w["n"])

    def holds(s):
        return enough(F.size(F.filter(w["hits"], lambda p: (p >= s) & (p < s + w["n"]))), size)

    size = F.least(last + w["n"], w["n"])
    near = clamp(F.flatten(F.transform(w["starts"], lambda s: F.sequence(s - SLACK, s + SLACK))))
    gaps = F.transform(F.sequence(F.lit(0), F.size(w["starts"]) - 1), between)
    far = let(near, lambda n: F.array_except(clamp(F.flatten(gaps)), n))
    return F.when(enough(F.size(w["hits"]), size), F.concat(*(
        F.transform(F.filter(starts, holds), lambda s: F.struct(
            s.alias("start"), F.lit(anchored).alias("anchored")))
        for starts, anchored in ((near, 1), (far, 0)))))


def _windows(source: DataFrame, anchors: DataFrame, percent: int) -> DataFrame:
    """One row per candidate window: document, item, start, its shingles and SimHash."""
    wanted = anchors.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("item", "n", "starts", "hits")).alias("wanted"))
    keys = ["doc_id", "row_key"]
    wanted = wanted.select(*(F.col(k).alias(f"w_{k}") for k in keys), "wanted")
    met = F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("row_key") == F.col("w_row_key"))
    # only texts with enough shared shingles are shuffled, whatever the lists' size
    few = small(written(wanted.drop("wanted"), "bench-keys"))
    held = source.join(few, met, "left_semi").join(wanted, met).select(
        *keys, shingles(F.col("text")).alias("all"), "wanted")
    cut = held.select(*keys, "all", F.explode("wanted").alias("w"))
    cut = cut.select(*keys, "w.item", "all", "w.n", F.explode(_starts(
        F.col("w"), F.size("all") - F.col("w.n"), percent)).alias("at"))
    cut = cut.select(*keys, "item", "at.start", "at.anchored", F.slice(
        "all", F.col("at.start") + 1, F.col("n")).alias("grams")).dropDuplicates(
            [*keys, "item", "start"])
    return cut.withColumn("print", simhash(F.col("grams")))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS,
          ) -> DataFrame:
    """One row per document and item that leaks into it.

    Columns doc_id, row_key, item_id, similarity (of the best window), start
    (word position of the first best window, an anchored one if any is as good)
    and windows (how many of the anchored ones reach the threshold; none if only
    windows between them do).
    """
    source = texts(docs)
    items = written(item_table(benchmark), "bench-items")
    probe = items.select("item", "n", F.posexplode("grams").alias("q", "gram"))
    grams = source.select("doc_id", "row_key", F.posexplode(shingles(F.col("text")))
                          .alias("p", "gram"))
    anchors = written(grams.join(probe, "gram").groupBy("doc_id", "row_key", "item", "n").agg(
        F.sort_array(F.collect_set(F.col("p") - F.col("q"))).alias("starts"),
        F.collect_set("p").alias("hits")).filter(100 * F.size("hits") >= percent * F.col("n")),
        "bench-anchors")             # in all, a similar window shares ``percent`` of the item
    windows = written(_windows(source, anchors, percent), "bench-windows")

    near = items.select("item", F.col("print").alias("item_print"), F.explode(_blocks(
        F.col("print"))).alias("b")).select("item", "item_print", "b.block", F.explode(F.array(
            *(F.col("b.value").bitwiseXOR(F.lit(m)) for m in _flips(radius // BLOCKS))))
            .alias("value"))
    keys = ["doc_id", "row_key", "item", "start"]
    met = windows.select(*keys, "print", F.explode(_blocks(F.col("print"))).alias("b")).select(
        *keys, "print", "b.block", "b.value").join(near, ["item", "block", "value"]).filter(
            F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    close = written(met.select(*keys).distinct(), "bench-close")

    same = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]
    held = windows.join(close.select(*(F.col(k).alias(f"c_{k}") for k in keys)),
                        same[0] & same[1] & same[2] & same[3], "left_semi")
    counts = held.select(*keys, "anchored", F.size("grams").alias("size"), F.explode("grams")
                         .alias("gram")).groupBy(*keys, "anchored", "size", "gram").agg(
        F.count("*").alias("there"))
    weights = items.select("item", "item_id", "n", F.explode("grams").alias("gram")).groupBy(
        "item", "item_id", "n", "gram").agg(F.count("*").alias("here"))
    scored = counts.join(weights, ["item", "gram"]).groupBy(
        *keys, "anchored", "item_id", "size", "n").agg(
        F.sum(F.least("here", "there")).alias("shared"))
    union = F.col("size") + F.col("n") - F.col("shared")
    return scored.filter(100 * F.col("shared") >= percent * union).withColumn(
        "similarity", F.col("shared") / union).groupBy("doc_id", "row_key", "item", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max_by("start", F.struct(
            "similarity", "anchored", -F.col("start"))).alias("start"),
        F.sum("anchored").alias("windows")) \
        .drop("item")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows into which any item leaks."""
    found = leaks(docs, benchmark, **options).select(
        F.col("doc_id").alias("_leak_doc_id"), F.col("row_key").alias("_leak_row_key")).distinct()
    return docs.join(small(written(found, "bench-leaks")), F.col("doc_id").cast("long").eqNullSafe(
        F.col("_leak_doc_id")) & (F.xxhash64("doc_id", "text") == F.col("_leak_row_key")), "left_anti")
