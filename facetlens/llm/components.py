"""Connected components of a link table, as DataFrame joins and minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it reaches.

    Every round takes the least label among neighbours and then the label of
    that label, so the rounds grow with the logarithm of a component's width.
    Each round is checkpointed in the shared folder.
    """
    both = kept_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                      .where("a <> b").distinct())
    labels = kept_table(both.groupBy("a").agg(F.min("b").alias("m"))
                        .select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        seen = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")))
        near = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("label", "m").alias("label"),
                                                                      F.col("label").alias("old"))
        near = kept_table(near)
        jump = near.select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = kept_table(near.join(jump, near["label"] == jump["at"])
                            .select("node", F.least("label", "further").alias("label"), "old"))
        if not labels.where("label <> old").head(1):
            return labels.select("node", "label")
        labels = labels.select("node", "label")
