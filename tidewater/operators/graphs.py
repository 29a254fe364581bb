"""Connected components, for rows that belong together over a chain of shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b; of one type, nulls ignored): component is the smallest node that can be reached.

    Labels are handed on to neighbours and then looked up at the label's own node, so rounds grow slowly with the longest chain. Rows stay
    as many as nodes and edges; nothing is gathered. It ends by itself: labels only fall.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    both = settled(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"))
    while True:
        of = labels.select(F.col("node").alias("b"), "component")
        near = both.where("a <> b").join(of, "b").groupBy("a").agg(F.min("component").alias("near")).select(F.col("a").alias("node"), "near")
        lower = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        ahead = labels.select(F.col("node").alias("now"), F.col("component").alias("ahead"))
        after = settled(lower.join(ahead, "now").select("node", "was", F.least("now", "ahead").alias("component")))
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
