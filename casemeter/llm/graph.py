"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemeter.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b); nodes of one component share a label, a node of it.

    Each round maps every node to its smallest neighbour and contracts the links, so the table shrinks by a factor when
    the order of the nodes has nothing to do with the links (nodes are digests). Rounds are written tables.
    """
    links = written(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while True:
        both = links.union(links.select("b", "a"))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
        if labels is None:
            labels = step
        else:
            ahead = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = written(labels.join(ahead, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        a = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        links = written(links.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if links.isEmpty():
            return labels
