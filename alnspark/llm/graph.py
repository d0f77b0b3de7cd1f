"""Connected components of an edge table, by label propagation with pointer jumping; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import hot_keys, join_salted, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): undirected, repeats and loops allowed. Returns id, component (the smallest id reachable).

    In each round every vertex takes the smallest label among its neighbours' and then that label's own label, so
    a path shortens at least by half. The smallest labels are combined before the shuffle, and the edges of a hub are
    dealt over several tasks where its label is looked up. So are the vertices that have one label in common.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    hubs = hot_keys(both, "b")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = join_salted(both, labels.select(F.col("id").alias("b"), "label"), "b", hubs).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = materialize(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new")), "stepped")
        heads = labels.select(F.col("id").alias("new"), F.col("label").alias("up"))
        least = F.least("new", F.coalesce("up", "new"))
        jumped = join_salted(stepped, heads, "new", hot_keys(stepped, "new"), "left").select("id", least.alias("label"), (least < F.col("label")).alias("moved"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("id", "label")
        if not jumped.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
