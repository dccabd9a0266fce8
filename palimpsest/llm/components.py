"""Connected components by label propagation with pointer jumping, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.joins import attach
from palimpsest.storage import discard, stage


def _followed(labels: DataFrame) -> DataFrame:
    """(label, further): where the label of a label is another one. A label that thousands of nodes share is one row here."""
    roots = labels.groupBy("label").agg(F.count("*").alias("n_rows"))
    own = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("further"))
    return roots.join(own, "label")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label), label the smallest node of the component, for the nodes of ``links`` (a, b).

    Each round takes the least label of a node's neighbours, then follows labels to their own label twice, so the
    rounds grow with the logarithm of a component's diameter. Every round is a written table, so a lost executor
    costs one round. Nothing but counts reaches the driver. A node of many links and a label of many nodes are met by
    rows that are aggregated first, or by ``attach``, which splits hot classes.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other"), "component-edges")
    labels = stage(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "component-labels")
    degrees = stage(edges.groupBy("other").agg(F.count("*").alias("n_rows")), "component-degrees")
    while True:
        theirs = stage(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")).join(degrees, "other"), "component-theirs")
        least = attach(edges, theirs, ["other"], how="inner").groupBy("node").agg(F.min("theirs").alias("theirs"))
        after = stage(labels.join(least, "node").select("node", F.col("label").alias("was"), F.least("label", "theirs").alias("label")), "component-labels")
        for _ in range(2):
            jump = stage(_followed(after), "component-jump")
            moved = attach(after, jump, ["label"]).select("node", "was", F.coalesce("further", "label").alias("label"))
            moved = stage(moved, "component-labels")
            discard(after)
            discard(jump)
            after = moved
        changed = after.where(F.col("was") != F.col("label")).limit(1).count()
        discard(labels)
        discard(theirs)
        labels = after.drop("was")
        labels._palimpsest_path = after._palimpsest_path
        if not changed:
            discard(edges)
            discard(degrees)
            return labels
