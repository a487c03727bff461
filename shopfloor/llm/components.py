"""Connected components of a link table: smallest reachable id by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import write_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) of every node that has a link.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so a chain of n links needs about log n rounds.
    Labels are written to the shared folder each round (no growing lineage).
    All joins have a side that is unique on the key, so a hub with many links
    is split by AQE and never gathered.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a)))
    edges = write_table(both.distinct(), "cc-edges")
    labels = write_table(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        near = (
            edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        )
        stepped = labels.join(near, labels["node"] == near["u"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")
        )
        target = stepped.select(F.col("node").alias("t_node"), F.col("label").alias("t_label"))
        jumped = stepped.join(target, stepped["label"] == target["t_node"], "left").select(
            "node", "old", F.least("label", F.coalesce("t_label", "label")).alias("label")
        )
        state = write_table(jumped, "cc-labels")
        labels = state.select("node", "label")
        if state.filter("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
