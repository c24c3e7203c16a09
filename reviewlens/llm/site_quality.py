"""Quality classifier with hierarchical empirical Bayes over sites and paths.

Three levels speak about a document:

* evidence: a logistic classifier on text statistics, fitted on the labelled
  training rows, as a log odds ratio against the base rate;
* host: the mean quality of the host's documents (training labels where known,
  else the classifier's posterior), shrunk toward the global mean;
* path: the mean of the host's section, shrunk toward its host.

How strongly a level shrinks comes from the data by the method of moments, so
sparse sites fall back on their parents and large ones speak for themselves.
A document's prior leaves the document itself out.  All levels are grouped
aggregations; hot hosts are pre-aggregated by Spark before the shuffle, and the
driver sees the coefficients and four numbers.

Defined results: null text has the statistics of an empty text; null host or
path is a value like any other; rows that repeat a doc_id are separate rows;
labels with a null id or class are ignored, of several labels of a document the
largest counts; without both classes among the labels the evidence is 0 and
every document is kept; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written
from .outlier_rules import text_statistics

FEATURES = ("x0", "x1", "x2", "x3", "length", "symbols", "short")
#: a document is kept unless its posterior of being good falls below this
KEEP = 0.2
HELD_OUT_MOD = 5


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def document_rows(docs: DataFrame, labels: DataFrame, host: str, path: str) -> DataFrame:
    """Statistics of every document with its host, path and (training) label."""
    held = F.coalesce(crc_mod(F.col("doc_id").cast("long"), HELD_OUT_MOD) == 0, F.lit(False))
    stats = text_statistics(docs.select("doc_id", "text", F.col(host).cast("string").alias("lang"),
                                        F.col(path).cast("string").alias("source")))
    known = labels.filter(~held & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()) \
        .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
            F.max("quality").cast("double").alias("label"))
    return stats.join(known, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", held.alias("held_out"), F.col("lang").alias("host"),
        F.col("source").alias("path"), "label", "x0", "x1", "x2", "x3",
        F.log1p("n_words").alias("length"), (F.col("n_symbols") > 0).cast("double").alias("symbols"),
        (F.col("n_words") < 50).cast("double").alias("short"))


def classify(rows: DataFrame) -> DataFrame:
    """``rows`` with the classifier's evidence (log odds ratio) and posterior."""
    known = rows.filter("label is not null")
    good, n = known.agg(F.sum("label"), F.count("*")).first()
    if not n or good in (0, n):
        return rows.withColumn("evidence", F.lit(0.0)).withColumn("posterior", F.lit(1.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = LogisticRegression(labelCol="label", maxIter=30, regParam=1e-4).fit(
        vectors.transform(known.select("label", *FEATURES)))
    out = model.transform(vectors.transform(rows)).withColumn(
        "posterior", vector_to_array("probability")[1])
    return out.withColumn("evidence", _odds(F.col("posterior")) - math.log(good / (n - good))) \
        .drop("features", "rawPrediction", "probability", "prediction")


def _strength(groups: DataFrame, parent: Column) -> float:
    """Pseudo-counts of the parent, from the spread of group means (method of moments)."""
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), parent))
    r = groups.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2)), F.sum("n"),
                   F.sum(p * (1 - p)), F.sum(F.col("n") * p * (1 - p))).first()
    if not r[1]:
        return 1.0
    spread = max((r[0] - r[2]) / r[1], 1e-6)       # between groups, beyond chance
    return min(max(r[3] / r[1] / spread - 1, 1.0), 1e6)


def site_posteriors(docs: DataFrame, labels: DataFrame, host: str = "source",
                    path: str = "lang", keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, held_out, host, path, evidence, host_mean, path_mean,
    score (posterior of being good) and kept."""
    rows = written(classify(written(document_rows(docs, labels, host, path), "site-rows"))
                   .withColumn("y", F.coalesce("label", "posterior")), "site-evidence")
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"),
                                                     F.sum("y").alias("good")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = good / total if total else 0.5
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), (
        (F.col("good") + k_host * mean) / (F.col("n") + k_host)).alias("host_mean"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(paths, F.col("host_mean"))
    paths = written(paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good",
                                 "host_mean"), "site-levels")
    prior = (F.col("good") - F.col("y") + k_path * F.col("host_mean")) / (F.col("n") - 1 + k_path)
    return rows.join(paths, F.col("host").eqNullSafe(F.col("h"))
                     & F.col("path").eqNullSafe(F.col("p"))).select(
        "doc_id", "held_out", "host", "path", "evidence", "host_mean", prior.alias("path_mean")) \
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_mean")))))) \
        .withColumn("kept", F.col("score") >= keep)
