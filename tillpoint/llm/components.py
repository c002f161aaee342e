"""Connected components of a graph of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: every linked node with the smallest node it reaches.

    Each round a node takes the smallest label around it and then that label's
    own label, so labels travel twice as far each round.  A node with many
    links is reduced by partial aggregation.  Each round is a stored table.
    """
    links = links.filter("a <> b")
    both = store(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), "links")
    labels = store(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        there = labels.select(F.col("node").alias("other"), F.col("component").alias("seen"))
        near = both.join(there, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("component", "seen").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = store(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), F.col("component").alias("old")), "labels")
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
