"""Connected components of an edge table by minimum labels and pointer jumps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.session import checkpoint, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that can be reached.

    A round takes the smallest label among the neighbours (partial minima, so
    a hub sends one row per task) and then the label of that label, which halves
    the depth. Rounds end when no label changes; each is cut by a checkpoint.
    """
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    pairs = checkpoint(pairs.distinct())
    labels = checkpoint(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        offered = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "node").select("node", F.least("label", "offer").alias("near"), F.col("label").alias("was"))
        lower = checkpoint(lower)
        jumped = lower.join(lower.select(F.col("node").alias("near"), F.col("near").alias("far")), "near", "left")
        before, after = labels, checkpoint(jumped.select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "was"))
        release(before, lower)
        if after.where("label <> was").isEmpty():
            release(pairs)
            return after.drop("was")
        labels = after
