"""Reproducible train / test splits and cross-validation folds.

A row's side depends only on its key and the seed (an md5 of
``"<seed>:<key>"``), so splits do not move when the data is repartitioned,
and the same rule is easy to write in any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPLIT_SEED, TEST_FRACTION


def split_hash(key: Column | str, seed: int = SPLIT_SEED) -> Column:
    """32-bit unsigned hash (first 8 hex digits of md5) as bigint."""
    k = F.col(key) if isinstance(key, str) else key
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 8)
    return F.conv(hexed, 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION,
               seed: int = SPLIT_SEED, out_col: str = "is_test") -> DataFrame:
    """Test when ``hash % 100 < 100 * fraction``: about, not exactly, the share."""
    cut = int(round(test_fraction * 100))
    return df.withColumn(out_col, ((split_hash(key, seed) % 100) < cut).cast("bigint"))


def _select_cut(keyed: DataFrame, k: int) -> tuple[int, object]:
    """(hash, key) of the k-th smallest row (1-based) by radix selection.

    Two passes over the 32-bit hash: count rows per upper half (at most
    65,536 rows reach the driver), step into the half that holds the k-th row,
    and do the same with the lower half.  Only rows sharing the final hash
    value are ordered by key.
    """
    prefix = 0
    for shift in (16, 0):
        sub = keyed if shift else keyed.filter(F.shiftright("h", 16) == prefix)
        counts = sorted(tuple(r) for r in sub.groupBy(
            F.shiftright("h", shift).bitwiseAND(65535).alias("b")).count().collect())
        for b, c in counts:
            if k <= c:
                prefix = (prefix << 16) | int(b)
                break
            k -= c
    ties = keyed.filter(F.col("h") == prefix).select("k").orderBy("k").limit(k)
    return prefix, ties.agg(F.max("k")).first()[0]


def exact_split(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION,
                seed: int = SPLIT_SEED, out_col: str = "is_test") -> DataFrame:
    """Exactly ``ceil(fraction * n)`` test rows: the first ones in (hash, key) order.

    The cut is found by radix selection over the key column (a few counting
    passes, no global sort), then every row is labelled by comparing its
    own (hash, key) with the cut - no join back, no checkpoint of the rows.
    Rows with a null key are training rows and do not count.
    """
    keyed = df.select(split_hash(key, seed).alias("h"), F.col(key).alias("k")).filter("k is not null")
    n = keyed.count()
    k = math.ceil(n * test_fraction)  # same double arithmetic as ceil(0.2 * n)
    h = split_hash(key, seed)
    if k <= 0:
        return df.withColumn(out_col, F.lit(0).cast("bigint"))
    if k >= n:
        return df.withColumn(out_col, F.col(key).isNotNull().cast("bigint"))
    h_cut, k_cut = _select_cut(keyed, k)
    test = (h < F.lit(h_cut)) | ((h == F.lit(h_cut)) & (F.col(key) <= F.lit(k_cut)))
    return df.withColumn(out_col, F.coalesce(test, F.lit(False)).cast("bigint"))


def three_way_split(df: DataFrame, key: str, fractions=(0.8, 0.1, 0.1),
                    seed: int = SPLIT_SEED, out_col: str = "part") -> DataFrame:
    """train / validation / test by hash ranges (80 / 10 / 10 by default)."""
    train_cut = int(round(fractions[0] * 100))
    val_cut = train_cut + int(round(fractions[1] * 100))
    b = split_hash(key, seed) % 100
    part = F.when(b < train_cut, "train").when(b < val_cut, "validation").otherwise("test")
    return df.withColumn(out_col, part)


def stratified_folds(df: DataFrame, key: str, label_col: str, folds: int,
                     seed: int = SPLIT_SEED, out_col: str = "fold") -> DataFrame:
    """Fold id per row: rows of each label are dealt round-robin in hash order.

    Ranks come from the skew-safe per-group ordinal on (key, label) only, so
    every fold gets its share of each class even when one class is a large
    majority; the fold ids are joined back on the key.
    """
    from .ordering import ordinal_in_group
    keys = df.select(key, label_col, split_hash(key, seed).alias("__h"))
    ranked = ordinal_in_group(keys, [label_col], ["__h", key], "__ord")
    ids = ranked.select(key, ((F.col("__ord") - 1) % folds).cast("int").alias(out_col))
    return df.join(ids, key)
