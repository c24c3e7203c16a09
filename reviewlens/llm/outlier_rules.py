"""Quality rules: robust multivariate outliers per language and source.

Every text gives a vector of transformed statistics (log mean word length; log
shares of symbols, of repeated lines and of words in repeated three-word runs).
For every (lang, source) the minimum-covariance-determinant estimate is found
by concentration steps: the ``SUPPORT`` share of rows nearest to the current
estimate gives the next mean and covariance, from a median / MAD start, until
the steps are done; a reweighted estimate over the rows inside the 97.5 %
ellipse follows.  A row whose squared Mahalanobis distance exceeds ``CUTOFF``
is rejected.  Each step is two partial aggregations over a table of numbers,
so a hot source costs its rows and no task holds a group.

Groups under ``MIN_GROUP`` fitted rows take the estimate of their language,
and small languages that of the whole table.  A floor on every variance keeps
statistics that are zero nearly everywhere from making the ellipse flat.

Defined results: null text has no words and fails the base rules; null lang or
source is a value like any other; rows that repeat a doc_id are separate rows;
ties do not matter (all rows at the cut distance are in the half); extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ship, text_buffer, text_slices, texts, window_hashes, window_starts,
                     word_hashes, word_spans, written, mix)

DIMS = 4
SUPPORT, STEPS, MIN_GROUP = 0.75, 5, 60
#: smallest standard deviation of each statistic, in its transformed unit; where a group's own spread
#: is nil, 2.8 % symbols, 13.4 % repeated lines or 13.4 % words in repeated runs are rejected alone
FLOOR = (0.05, 0.25, 0.5, 0.5)
MIN_WORDS, MAX_REPEAT = 50, 50


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


#: squared distance beyond which a row is rejected: one clean row in 10^5 of a normal law
CUTOFF = chi2_quantile(1 - 1e-5, DIMS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _per_text(flags, offs):
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offs[1:]] - total[offs[:-1]]


def _stats(batches):
    for batch in batches:
        for part in text_slices(batch):
            data, offs = text_buffer(part.column("text"))
            start, end, ptr = word_spans(data, offs)
            n_words = np.diff(ptr)
            chars = _per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), offs)
            symbols = _per_text(_SYMBOL[data], offs)
            at = window_starts(ptr, 3)
            row = np.repeat(np.arange(len(n_words)), np.maximum(n_words - 2, 0))
            grams = window_hashes(word_hashes(data, start, end), 3)[at]
            keys = mix(grams + mix(row.astype(np.uint64)))
            order = np.argsort(keys)
            k = keys[order]
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            twice = at[order[same[:-1] | same[1:]]]
            cover = np.zeros(len(start), bool)
            for t in range(3):
                cover[twice + t] = True
            repeats = _per_text(cover, ptr)
            dup, lines = [], []
            for a, b in zip(offs[:-1], offs[1:]):
                full = [x for x in data[a:b].tobytes().split(b"\n") if x.strip()]
                lines.append(len(full))
                dup.append(len(full) - len(set(full)))
            dup, lines = np.array(dup, np.int64), np.array(lines, np.int64)
            words = np.maximum(n_words, 1)
            yield ship(
                doc_id=part.column("doc_id"), lang=part.column("lang"),
                source=part.column("source"), n_words=n_words.astype(np.int64), word_chars=chars,
                n_symbols=symbols, n_dup_lines=dup, n_repeat_words=repeats,
                x0=np.log(np.maximum(chars, 1) / words),
                x1=np.log1p(100 * symbols / np.maximum(chars, 1)),
                x2=np.log1p(100 * dup / np.maximum(lines, 1)),
                x3=np.log1p(100 * repeats / words))


STATS = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
         "n_dup_lines long, n_repeat_words long, x0 double, x1 double, x2 double, x3 double")
FIT = "g long, mean array<double>, inverse array<double>"


def _estimate(scale: float):
    """Sums of a group's chosen rows -> mean and inverse covariance (floored)."""
    def run(batches):
        for batch in batches:
            g, means, inverses = [], [], []
            for row in batch.to_pylist():
                n = row["n"]
                mean = np.array([row[f"s{i}"] for i in range(DIMS)]) / n
                cov = np.array([[row[f"q{min(i, j)}{max(i, j)}"] for j in range(DIMS)]
                                for i in range(DIMS)]) / n - np.outer(mean, mean)
                cov = cov * scale + np.diag(np.square(FLOOR))
                g.append(row["g"])
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(cov).reshape(-1).tolist())
            yield ship(g=pa.array(g, pa.int64()), mean=pa.array(means, pa.list_(pa.float64())),
                       inverse=pa.array(inverses, pa.list_(pa.float64())))
    return run


def _distance():
    return " + ".join(f"(x{i} - mean[{i}]) * (x{j} - mean[{j}]) * inverse[{i * DIMS + j}]"
                      for i in range(DIMS) for j in range(DIMS))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g").agg(
        F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}")
          for i in range(DIMS) for j in range(i, DIMS)))


def _groups(stats: DataFrame) -> DataFrame:
    """(lang, source, g): the estimate each language and source uses."""
    counts = stats.groupBy("lang", "source").agg(
        F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    langs = counts.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"))
    return counts.join(langs, F.col("lang").eqNullSafe(F.col("l"))).select(
        F.col("lang").alias("gl"), F.col("source").alias("gs"),
        F.when(F.col("n") >= MIN_GROUP, F.xxhash64(F.lit(2), "lang", "source"))
        .when(F.col("n_lang") >= MIN_GROUP, F.xxhash64(F.lit(1), "lang"))
        .otherwise(F.lit(0)).alias("g"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Base statistics, transformed vector and base verdict of every document."""
    return texts(docs, F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(
        _stats, STATS).withColumn("base_failed", F.expr(
            f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words"))


def fit(rows: DataFrame) -> DataFrame:
    """Robust mean and inverse covariance of every group ``g`` in ``rows``."""
    xs = [f"x{i}" for i in range(DIMS)]
    mid = rows.groupBy("g").agg(*(F.percentile_approx(x, 0.5).alias(f"m{x}") for x in xs))
    mad = rows.join(mid, "g").groupBy("g").agg(
        *(F.first(f"m{x}").alias(f"m{x}") for x in xs),
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{x}")), 0.5).alias(f"d{x}") for x in xs))
    diagonal = [f"1 / (pow(1.4826 * d{x}, 2) + {FLOOR[i] ** 2})" for i, x in enumerate(xs)]
    fits = written(mad.select("g", F.array(*(f"m{x}" for x in xs)).alias("mean"), F.expr(
        "array(" + ", ".join(diagonal[i] if i == j else "0D" for i in range(DIMS)
                             for j in range(DIMS)) + ")").alias("inverse")), "mcd-fit")
    half = chi2_quantile(SUPPORT, DIMS)
    for _ in range(STEPS):
        far = rows.join(fits, "g").withColumn("d2", F.expr(_distance()))
        cut = far.groupBy("g").agg(F.percentile_approx("d2", SUPPORT).alias("cut"))
        fits = written(_sums(far.join(cut, "g").filter("d2 <= cut")).mapInArrow(
            _estimate(SUPPORT / chi2_cdf(half, DIMS + 2)), FIT), "mcd-fit")
    wide = chi2_quantile(0.975, DIMS)
    inside = rows.join(fits, "g").filter(F.expr(_distance()) <= wide)
    return written(_sums(inside).mapInArrow(_estimate(0.975 / chi2_cdf(wide, DIMS + 2)), FIT),
                   "mcd-fit")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: base statistics, base_failed, distance (squared) and kept."""
    stats = written(text_statistics(docs), "mcd-stats")
    groups = written(_groups(stats), "mcd-groups")
    rows = stats.join(groups, F.col("lang").eqNullSafe(F.col("gl"))
                      & F.col("source").eqNullSafe(F.col("gs")))
    # an estimate for a language or for all covers every row below it
    fitted = rows.filter("not base_failed")
    levels = groups.select("g").distinct()
    shared = fitted.select(F.explode(F.array(F.xxhash64(F.lit(1), "lang"), F.lit(0).cast("long")))
                           .alias("g"), *(f"x{i}" for i in range(DIMS))).join(levels, "g")
    own = fitted.filter(F.col("g") == F.xxhash64(F.lit(2), "lang", "source")).select(
        "g", *(f"x{i}" for i in range(DIMS)))
    fits = fit(written(own.union(shared), "mcd-rows"))
    return rows.join(fits, "g", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.expr(f"not base_failed and coalesce({_distance()}, 0D) <= {CUTOFF}")
        .alias("kept"), F.expr(_distance()).alias("distance"))
