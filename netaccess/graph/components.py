"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.runtime import discard, materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every end of an edge; the component is its least node.

    Each round every node takes the least label among itself and its neighbours, then the label of that
    label. Long chains shrink by halves, stars end at once. Labels go through the shared folder.
    """
    pairs = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).filter("a is not null and b is not null")
    both = materialize(pairs.union(pairs.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    loops = pairs.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc-labels")
    while True:
        before = labels
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        moved = materialize(moved, "cc-moved")
        discard(before)
        target = moved.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = materialize(moved.join(target, "label", "left").select("node", "old", F.coalesce("jump", "label").alias("label")), "cc-labels")
        discard(moved)
        if labels.filter("label <> old").limit(1).count() == 0:
            discard(both)
            break
    return labels.select("node", F.col("label").alias("component")).union(loops.join(labels, "node", "left_anti").distinct())
