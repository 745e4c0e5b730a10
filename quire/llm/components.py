"""Connected components over edges: min labels spread along edges, then labels jump to their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label), staged: label is the least node that can be reached. edges: (a, b) of any ordered type, any direction, repeats allowed.

    Only nodes with an edge come back. Every round aggregates by node with map-side partial minima and
    joins against one row per node, so a node with very many edges never gathers in a task. Rounds go on
    until no label changes; a round's tables go once the next has read them.
    """
    both = edges.where("a <> b")
    both = staged(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        met = staged(labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "m").alias("new")), "met")
        # hooking: a label that meets a smaller one passes it on to all who carry it
        hooks = met.groupBy("label").agg(F.min("new").alias("hook"))
        jumped = met.join(hooks, "label").select("node", "label", F.least("new", "hook").alias("new"))
        roots = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        jumped = jumped.join(roots, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("label"), (F.least("new", F.coalesce("up", "new")) != F.col("label")).alias("moved"))
        jumped = staged(jumped, "jumped")
        changed = jumped.where("moved").limit(1).count()
        discard(met, labels)
        labels = jumped
        if not changed:
            break
    discard(both)
    out = labels.select("node", "label")
    out.staged_at = labels.staged_at
    return out
