"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import cut_lineage, discard


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b): label is the least node of its component.

    Each round takes the least label among the neighbours (combined map-side, so hubs don't collect in a task) and then
    follows labels once, which halves the distance to the root. Raises if ``most_rounds`` don't suffice.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        root = labels.select(F.col("node").alias("r"), F.col("label").alias("top"))
        step = hooked.join(root, hooked["next"] == root["r"], "left").select("node", F.least("next", F.coalesce("top", "next")).alias("label"), "old")
        before, labels = labels, cut_lineage(step)
        settled = labels.where("label <> old").isEmpty()
        discard(before)
        if settled:
            discard(both)
            return labels.select("node", "label")
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
