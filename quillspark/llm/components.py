"""Connected components of a link table by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component) for every id of ``nodes``: the least id that links (a, b) reach, itself included.

    A round takes the least label of a node and its neighbours, then the label of that label; labels are nodes of the same
    component, so the second step halves what is left of a long chain. Every round is written to the shared folder. A node
    with very many links is pre-aggregated: minima are formed before the shuffle.
    """
    links = links.distinct()
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    linked = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("component"))
    labels = written(linked, "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component")
        least = near.unionByName(labels).groupBy("id").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        after = least.join(jump, "component", "left").select("id", F.least("component", F.coalesce("beyond", "component")).alias("component"))
        after = written(after, "labels")
        changed = not after.join(labels.withColumnRenamed("component", "before"), "id").filter("component <> before").isEmpty()
        labels = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    lone = nodes.select("id").distinct().join(labels, "id", "left")
    return lone.select("id", F.coalesce("component", "id").alias("component"))
