"""Weak labels: promotion rules, expanded feature phrases, extreme ratings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PROMO_PATTERNS
from ..functions import text as T
from ..session import counted_broadcast, materialize, row_name
from .feature_index import rows_with_features


def _five(rating_col: str):
    return F.coalesce(F.col(rating_col) == 5, F.lit(False))


def promo_flag(df: DataFrame, text_col: str, patterns: Iterable[str] | None = None,
               out_col: str = "is_promotional") -> DataFrame:
    """1 when the raw text matches any promotion pattern (one alternation)."""
    pats = PROMO_PATTERNS if patterns is None else tuple(patterns)
    return df.withColumn(out_col, T.matches_any(F.col(text_col), pats).cast("bigint"))


def rule_label(df: DataFrame, *, text_col: str, rating_col: str,
               patterns: Iterable[str] | None = None, combine: str = "and",
               label_col: str = "is_inducing", keep_promo: bool = True) -> DataFrame:
    """Inducement label from the promotion rule.

    ``combine='and'``: rating is 5 and a pattern matches (null rating -> 0).
    ``combine='or'``: the variant that adds the promotion flag and clips to
    0/1, i.e. any match labels the review.
    """
    out = promo_flag(df, text_col, patterns, "is_promotional")
    promo = F.col("is_promotional") == 1
    cond = (_five(rating_col) & promo) if combine == "and" else promo
    out = out.withColumn(label_col, cond.cast("bigint"))
    return out if keep_promo else out.drop("is_promotional")


def feature_label(df: DataFrame, *, text_col: str, rating_col: str,
                  features: Iterable[str] | DataFrame, label_col: str = "is_inducing",
                  delimiter_as_space: str | None = None, id_col: str | None = None) -> DataFrame:
    """1 when the rating is 5 and any feature phrase is a substring of the text.

    A list of ``features`` becomes one native expression.  A table (first
    column) of any size is joined by an inverted index of its grams
    (:mod:`.feature_index`); ``id_col`` then names a unique key of ``df``, and
    without one the rows are written with a key first.
    ``delimiter_as_space`` names the joint of mined phrases (``a_b``), which
    then also match the space-joined text.
    """
    if isinstance(features, DataFrame):
        return _label_by_index(df, text_col, rating_col, features, label_col, delimiter_as_space, id_col)
    features = [f.replace(delimiter_as_space, " ") if delimiter_as_space else f
                for f in features if f is not None]
    cond = _five(rating_col) & T.contains_any(F.col(text_col), features)
    return df.withColumn(label_col, cond.cast("bigint"))


def _label_by_index(df, text_col, rating_col, features, label_col, delimiter, id_col):
    columns = [c for c in df.columns if c != label_col]
    key = id_col
    if key is None:
        key = row_name(df)
        df = materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
    feature = F.col(features.columns[0]).cast("string")
    if delimiter:
        feature = F.replace(feature, F.lit(delimiter), F.lit(" "))
    five = df.filter(_five(rating_col)).select(F.col(key).alias("row"), F.col(text_col).alias("text"))
    hits = materialize(rows_with_features(five, features.select(feature.alias("feature"))), "feature_hits")
    hit = row_name(df, "hit")
    return (df.join(counted_broadcast(hits.withColumnRenamed("row", hit)), F.col(key) == F.col(hit), "left")
            .select(*columns, F.col(hit).isNotNull().cast("bigint").alias(label_col)))


def extreme_label(df: DataFrame, rating_col: str, label_col: str = "is_extreme") -> DataFrame:
    """README rule: a review that is too positive or too negative (1 or 5)."""
    return df.withColumn(label_col, F.coalesce(F.col(rating_col).isin(1, 5), F.lit(False)).cast("bigint"))
