"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of a link ``(u, v)``: the label is the smallest node of its
    component. Each round takes the least label among the neighbours and then the label of that
    label, so chains shrink by doubling; all sums and minima combine before they move, and each
    round is cut off by a checkpoint. No link or label comes to the driver."""
    both = checkpointed(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).where("u <> v").distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        better = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = better.select(F.col("node").alias("at"), F.col("label").alias("up"))
        nxt = checkpointed(better.join(jump, better.label == jump["at"], "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = nxt.where("label <> was").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
