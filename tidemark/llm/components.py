"""Connected components of an edge table by label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node of each node's component.

    ``edges`` has long columns u and v; nodes without an edge are absent from the
    result.  Each round takes the smallest label among a node and its neighbours
    (aggregated before the shuffle, so hubs cost a row per task) and then the label
    of that label, which halves long chains; it ends when no label changes, and raises
    if labels still change after ``max_rounds``.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = settle(both, "cc-edges")
    labels = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "cc-labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("seen"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = near.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = settle(jumped, "cc-labels")
        changed = new.where("label <> old").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        labels._settled_at = new._settled_at
        if not changed:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    discard(both)
    return labels
