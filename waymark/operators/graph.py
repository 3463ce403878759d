"""Connected components by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.lineage import cut


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component.

    ``nodes``: node (unique); ``links``: a, b, in one direction or both. Labels go along the
    links and jump to the label of their label, to convergence; each round is
    checkpointed, so its lineage does not grow and an executor may be lost.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        new = labels.join(offered, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(new.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
