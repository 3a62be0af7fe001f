"""Connected components of a link table, by minimum labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b); the label is the smallest node of the component.

    Labels move along links by a grouped minimum (summed up before the shuffle) and then jump to their label's label, so
    the number of rounds grows with the logarithm of the longest path. Links and labels never leave the executors.
    """
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other")
                .groupBy("node").agg(F.min("seen").alias("seen")))
        moved = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("seen", "label")).alias("new"))
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("next"))
        after = materialize(moved.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")), "labels")
        if after.where("label <> new").limit(1).count() == 0:
            return after.select("node", "label")
        labels = after.select("node", F.col("new").alias("label"))
