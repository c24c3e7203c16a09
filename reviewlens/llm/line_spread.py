"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate, however often one site repeats
it.  Each line hash gets a HyperLogLog sketch of its sites; sketches of a line
merge by aggregation (partially in every task, so a line in every document is
one sketch per task).  Lines whose estimate is within the sketch's error of the
threshold get an exact distinct count; the rest are decided by the estimate.
Lines that reach ``min_sites`` are cut from every document.

Defined results: null text has no lines and stays empty; blank lines are never
cut; a null site is one more site; rows that repeat a doc_id are separate rows;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

LG_K = 12
MIN_SITES = 8
#: three standard errors of a sketch with 2**LG_K registers
BAND = 3 * 1.04 / (1 << LG_K) ** 0.5


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(doc_id, row_key, site, pos, h1, h2): hashes of the lines that hold a word."""
    held = texts(docs, F.coalesce(F.col(site).cast("string"), F.lit("\0null")).alias("site"))
    line = held.select("doc_id", "row_key", "site", F.posexplode(F.split("text", "\n"))
                       .alias("pos", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return line.select("doc_id", "row_key", "site", "pos", F.xxhash64("line").alias("h1"),
                       F.hash("line").alias("h2"))


def common_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that stand on at least ``min_sites`` distinct sites."""
    lines = _lines(docs, site)
    spread = written(lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - BAND) - 1), "line-spread")
    unsure = F.col("sites") <= min_sites * (1 + BAND) + 1
    near = spread.filter(unsure).select("h1", "h2")
    exact = (lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
             .groupBy("h1", "h2").count().filter(F.col("count") >= min_sites).select("h1", "h2"))
    return spread.filter(~unsure).select("h1", "h2").union(exact)


def remove_common_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
                        ) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text, kept_sha256."""
    common = written(common_lines(docs, site, min_sites), "line-common")
    hits = (_lines(docs, site).join(common, ["h1", "h2"], "left_semi")
            .groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("cut")))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "cut")
    held = texts(docs).join(hits, F.col("doc_id").eqNullSafe(F.col("d"))
                            & (F.col("row_key") == F.col("k")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.when(F.col("cut").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(
        F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                             lambda s: ~F.array_contains("cut", s["i"])), lambda s: s["x"]), "\n"))
    return held.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
                       .cast("long").alias("n_lines"),
                       F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"),
                       kept.alias("kept_text")).withColumn(
                           "kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256))
