"""Connected components of a link table, by repeated smallest-neighbour steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links(a, b)``; comp is the smallest node reachable.

    Each step takes the smallest label among a node's neighbours and then
    follows that label once, so long chains halve; the loop ends when no label
    changes.  Only that count reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(
        F.least("a", F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("least"))
        step = labels.join(near, "node").select(
            "node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = written(step.join(jump, "comp", "left").select(
            "node", "old", F.least("comp", "further").alias("comp")), "labels")
        if step.filter("comp < old").isEmpty():
            return step.select("node", "comp")
        labels = step.select("node", "comp")
