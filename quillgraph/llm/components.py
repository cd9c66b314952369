"""Connected components by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Each round takes the least label of the neighbours (partial sums first, so a hub is no burden), then the label
    of that label; labels are written to the shared folder. Rounds grow with the logarithm of the diameter.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("beyond"))
        new = new.join(jump, "new").select("node", F.least("new", "beyond").alias("new"), "label")
        new = written(new, "labels")
        dropped(labels)
        labels = new.select("node", F.col("new").alias("label"))
        if not new.where("new <> label").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
