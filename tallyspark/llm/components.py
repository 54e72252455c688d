"""Connected components of a link table, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.store import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str = "labels") -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node that is linked to it in any number of steps.

    Every round takes the smallest label over each node's links and then that label's own label, so that chains shorten
    by half or better. Labels are written out each round; a node that has most links is one row in each grouping's result.
    """
    both = work.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}_links")
    labels = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), f"{name}0")
    rounds = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "low").alias("low"))
        hop = labels.select(F.col("node").alias("n"), F.col("label").alias("further"))
        new = low.join(hop, F.col("low") == F.col("n"), "left").select("node", F.least("low", "further").alias("label"), (F.least("low", "further") != F.col("label")).alias("changed"))
        rounds += 1
        saved = work.save(new, f"{name}{rounds}")
        work.drop(f"{name}{rounds - 1}")
        labels = saved.select("node", "label")
        if saved.where("changed").isEmpty():
            work.drop(f"{name}_links")
            return labels
