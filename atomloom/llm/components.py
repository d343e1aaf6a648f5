"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.llm.common import materialize, materialize_counting


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node of the undirected edges (a, b): the smallest id reachable.

    Each round gives every node the smallest label among its neighbours and itself, then the label of its label
    (pointer jumping); it ends when nothing changes. Edges with a null end, or from a node to itself, name their nodes and
    join nothing; no edges give no rows. A round is written to the shared folder, so it is never computed
    again. Neighbour minima are combined before the shuffle, so a node with very many neighbours is no hot key there.
    """
    edges = edges.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).filter(F.col("a").isNotNull())
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("heard"))
        pulled = labels.join(heard, labels["id"] == heard["a"], "left").select("id", "component", F.least("component", F.coalesce("heard", "component")).alias("least"))
        target = labels.select(F.col("id").alias("target"), F.col("component").alias("jump"))
        jumped = pulled.join(target, pulled["least"] == target["target"], "left").select(
            "id", F.least("least", F.coalesce("jump", "least")).alias("next"), F.col("component").alias("before")
        )
        new, moved = materialize_counting(jumped, f"{name}-{step}", F.col("next") != F.col("before"))
        labels = new.select("id", F.col("next").alias("component"))
        if not moved:
            return labels
