"""Connected components of a link table by joins and aggregates.

Every node takes the smallest label among itself and its neighbours, then the label of its label; both
steps repeat until nothing changes. A node with very many links is reduced in each task before the
shuffle. Each round is a written table, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import stage


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; label is the smallest node reachable. Self links are allowed."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = stage(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        own = labels.select("node", "label")
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        stepped = own.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        moved = stage(stepped.join(roots, "low", "left").select(
            "node", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("changed")), "labels")
        if not moved.where("changed").limit(1).count():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
