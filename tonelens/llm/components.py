"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tonelens.plans.workdir import materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links`` (``a``, ``b``); ``label`` is the least node that it reaches.

    Each round takes the least label among a node and its neighbours, then the label of that label, so stars take two
    rounds and paths a logarithmic number.  A node with many links is reduced map-side, a label that many nodes carry
    is a skewed join key, which Spark splits.  Every round is written to the shared folder.
    """
    links = links.select("a", "b").filter("a <> b")
    both = materialise(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialise(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["b"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        via = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step = lower.join(via, lower["label"] == via["_n"], "left").select(
            "node", "old", F.least("label", F.coalesce("_l", "label")).alias("label")
        )
        step = materialise(step, "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
