"""Order-dependent operators that stay exact and balanced under skew.

* ``top_k_per_group`` - ``row_number() <= k``; Spark plans a partial
  ``WindowGroupLimit`` before the shuffle, so each map task sends at most k
  rows per group and a hot group cannot flood one reducer.
* ``ordinal_in_group`` - a full per-group ``row_number`` without a window
  over the whole group: a global range sort splits hot groups over many
  tasks, each task numbers its rows, and per-(group, task) counts (at most
  one row per task and group) give the offsets.
* ``running_totals`` - global running sums (dense index, cumulative counts)
  from per-partition totals plus offsets; no un-partitioned window over data.

The sorted and tagged data is written once to the shared checkpoint folder
(``session.materialize``), so the partition ids stay fixed if a task is
recomputed after an executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PID, _MID = "__pid", "__mid"


def _cols(cols) -> list:
    return [cols] if isinstance(cols, (str, Column)) else list(cols)


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int,
                    rank_col: str | None = None) -> DataFrame:
    """Rows ranked 1..k within each group by ``order_cols`` (make it total)."""
    w = Window.partitionBy(*_cols(group_cols)).orderBy(*_cols(order_cols))
    rank = rank_col or "__rank"
    out = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    if rank_col:
        return out.withColumn(rank_col, F.col(rank_col).cast("bigint"))
    return out.drop(rank)


def _tagged(df: DataFrame, order_cols: Sequence) -> DataFrame:
    tagged = (df.orderBy(*order_cols)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    return materialize(tagged, "ordered")


def ordinal_in_group(df: DataFrame, group_cols, order_cols,
                     out_col: str = "ordinal") -> DataFrame:
    """1-based position of each row within its group, ordered by ``order_cols``.

    ``order_cols`` must make the order total inside a group (add a unique key
    as the last column).  Equal to ``row_number() over (partition by group
    order by order)``.
    """
    groups = [F.col(c) if isinstance(c, str) else c for c in _cols(group_cols)]
    group_names = [c if isinstance(c, str) else None for c in _cols(group_cols)]
    if any(n is None for n in group_names):
        raise ValueError("group_cols must be column names")
    tagged = _tagged(df, groups + [F.col(c) if isinstance(c, str) else c for c in _cols(order_cols)])
    per_task = (tagged.groupBy(_PID, *group_names)
                .agg(F.min(_MID).alias("__first"), F.count(F.lit(1)).alias("__n")))
    w = (Window.partitionBy(*group_names).orderBy(_PID)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_task = per_task.withColumn("__offset", F.sum("__n").over(w) - F.col("__n"))
    return (tagged.join(per_task, [_PID, *group_names])
            .withColumn(out_col, (F.col(_MID) - F.col("__first") + 1 + F.col("__offset")).cast("bigint"))
            .drop(_PID, _MID, "__first", "__n", "__offset"))


def running_totals(df: DataFrame, order_cols, sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums over the global order of ``order_cols``.

    ``sums`` maps output column -> per-row value.  The order must be total.
    Per-partition totals (one row per partition) are offset with a window
    over those few rows and broadcast back.
    """
    staged = df.select("*", *[v.alias(f"__v_{k}") for k, v in sums.items()])
    tagged = _tagged(staged, [F.col(c) if isinstance(c, str) else c for c in _cols(order_cols)])
    totals = tagged.groupBy(_PID).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}")
                                    for k in sums])
    local = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tagged.join(F.broadcast(offsets), _PID)
    for k in sums:
        out = out.withColumn(k, F.col(f"__o_{k}") + F.sum(f"__v_{k}").over(local))
    return out.drop(_PID, _MID, *[f"__v_{k}" for k in sums], *[f"__o_{k}" for k in sums])


def dense_index(df: DataFrame, order_cols, out_col: str = "idx") -> DataFrame:
    """0-based position in the global order of ``order_cols`` (a total order)."""
    return (running_totals(df, order_cols, {out_col: F.lit(1)})
            .withColumn(out_col, (F.col(out_col) - 1).cast("bigint")))


def first_in_group(df: DataFrame, group_cols, order_cols, value_cols) -> DataFrame:
    """Value(s) of the first row per group: a partial ``min_by`` aggregate.

    ``order_cols`` is one column or a list; on equal order values the row with
    the smallest ``value_cols`` is first, so the result never depends on the
    order in which tasks finish.
    """
    order = F.struct(*_cols(order_cols), *_cols(value_cols))
    return df.groupBy(*_cols(group_cols)).agg(
        *[F.min_by(c, order).alias(c) for c in _cols(value_cols)])
