"""Collection-side operators: which entities to read next, review caps,
ordinals and completeness - the data half of the original collector."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CLOSED_STATUS, MAX_BLOCKS, REVIEWS_PER_BLOCK
from .ordering import ordinal_in_group, top_k_per_group


def eligible_listings(df: DataFrame, name_col: str = "name", status_col: str = "status",
                      closed: str = CLOSED_STATUS) -> DataFrame:
    """Name not blank, and no status or a status other than ``closed``."""
    name_ok = F.coalesce(F.trim(F.col(name_col)) != "", F.lit(False))
    status_ok = F.col(status_col).isNull() | (F.col(status_col) != closed)
    return df.filter(name_ok & status_ok)


def listing_conditions(df: DataFrame, rating_col: str, min_rating: float = 4.5,
                       hours_col: str | None = None, ts_col: str | None = None,
                       day_of_week: int = 7, at_minute: int = 12 * 60) -> DataFrame:
    """Rating at least ``min_rating`` and open on ``day_of_week`` at ``at_minute``.

    With ``hours_col`` (array<struct<dow,open,close>>, minutes of the day) the
    opening test is an ``exists`` over the listing's hours; with ``ts_col``
    a time stamp must fall on that weekday and hour.  Day numbers follow
    Spark's ``dayofweek``: 1 = Sunday ... 7 = Saturday.
    """
    cond = F.col(rating_col) >= min_rating
    if hours_col:
        cond = cond & F.exists(hours_col, lambda h: (h["dow"] == day_of_week)
                               & (h["open"] <= at_minute) & (F.lit(at_minute) < h["close"]))
    if ts_col:
        cond = cond & (F.dayofweek(ts_col) == day_of_week) & (F.hour(ts_col) == at_minute // 60)
    return df.filter(cond)


def _names_df(spark, names: Iterable[str], col: str) -> DataFrame:
    names = sorted(set(names))
    return spark.createDataFrame([(n,) for n in names], f"{col} string")


def exclude_names(df: DataFrame, name_col: str, excluded: Iterable[str]) -> DataFrame:
    """Left anti join against a bounded exclusion list (broadcast)."""
    ex = _names_df(df.sparkSession, excluded, name_col)
    return df.join(F.broadcast(ex), name_col, "left_anti")


def search_keyword(df: DataFrame, name_col: str, suffix_col: str, ambiguous: Iterable[str],
                   out_col: str = "keyword", sep: str = " ", key_col: str | None = None) -> DataFrame:
    """Name, with a suffix appended when the key (default: the name) is in
    the ambiguous list - a left join against a broadcast, bounded list."""
    amb = _names_df(df.sparkSession, ambiguous, "__amb").withColumn("__flag", F.lit(True))
    flagged = df.join(F.broadcast(amb), F.col(key_col or name_col) == F.col("__amb"), "left")
    kw = F.when(F.col("__flag"), F.concat_ws(sep, F.col(name_col), F.col(suffix_col))).otherwise(F.col(name_col))
    return flagged.withColumn(out_col, kw).drop("__amb", "__flag")


def seen_entities(df: DataFrame, name_col: str) -> DataFrame:
    """Distinct names already stored (column-pruned scan + distinct)."""
    return df.select(name_col).filter(F.col(name_col).isNotNull()).distinct()


def unseen_entities(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Candidates not yet stored: a left anti join on the key."""
    return candidates.join(stored.select(key).distinct(), key, "left_anti")


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def count_clamp(counts: DataFrame, count_col: str, cap: int = MAX_BLOCKS * REVIEWS_PER_BLOCK,
                out_col: str = "capped") -> DataFrame:
    return counts.withColumn(out_col, F.least(F.col(count_col), F.lit(cap)).cast("bigint"))


def collection_completeness(collected: DataFrame, announced: DataFrame, key: str,
                            cap: int = MAX_BLOCKS * REVIEWS_PER_BLOCK) -> DataFrame:
    """Collected rows per entity against the announced (capped) count.

    Both sides are pre-aggregated per key before the join; status is
    ``complete`` when collected >= min(announced, cap).
    """
    got = collected.groupBy(key).agg(F.count(F.lit(1)).alias("collected"))
    want = announced.groupBy(key).agg(F.count(F.lit(1)).alias("announced"))
    j = want.join(got, key, "left").withColumn("collected", F.coalesce("collected", F.lit(0)).cast("bigint"))
    expected = F.least(F.col("announced"), F.lit(cap))
    return j.select(key, F.col("announced").cast("bigint").alias("announced"),
                    expected.cast("bigint").alias("expected"), "collected",
                    F.when(F.col("collected") >= expected, "complete").otherwise("partial").alias("status"))


def cap_per_group(df: DataFrame, group_col: str, order_cols, cap: int = MAX_BLOCKS * REVIEWS_PER_BLOCK,
                  rank_col: str = "rank") -> DataFrame:
    """At most ``cap`` rows per group, the first by ``order_cols``."""
    return top_k_per_group(df, group_col, order_cols, cap, rank_col)


def rows_after_position(df: DataFrame, group_col: str, order_cols, stored: int | DataFrame,
                        ordinal_col: str = "ordinal") -> DataFrame:
    """Rows past the stored position of their group (only the newest block).

    ``stored`` is a fixed position, or a table (group, position) of the
    last stored position per group (missing groups start at 0).
    """
    ranked = ordinal_in_group(df, [group_col], order_cols, ordinal_col)
    if isinstance(stored, int):
        return ranked.filter(F.col(ordinal_col) > stored)
    return (ranked.join(stored.select(group_col, F.col(stored.columns[1]).alias("__last")), group_col, "left")
            .filter(F.col(ordinal_col) > F.coalesce("__last", F.lit(0))).drop("__last"))


def prefer_full_text(full, snippet):
    """Full text when present and non-empty, else the snippet body."""
    return F.coalesce(F.nullif(full, F.lit("")), snippet)
