"""Shortest paths as relational rounds: states (src, node) relax over an edge table until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.runtime import discard, materialize


def shortest_paths(adjacency: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node, dist) of every node that a source reaches.

    ``sources``: src, node, a start of distance 0; starts that share a src form one super-source.
    ``adjacency``: a, b, w >= 0. Each round relaxes only states that the round before it improved.
    """
    adjacency = materialize(adjacency.select("a", "b", "w"), "path-edges")
    best = materialize(sources.select("src", "node", F.lit(0.0).alias("dist"), F.lit(True).alias("new")).distinct(), "path-start")
    while True:
        front = best.filter("new")
        reached = front.join(adjacency, front["node"] == adjacency["a"]).select("src", F.col("b").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(True).alias("new"))
        both = best.withColumn("new", F.lit(False)).union(reached)
        # two minima of doubles keep the aggregation hashed; of equal distances the old state wins, so that it does not count as improved
        least = both.groupBy("src", "node").agg(F.min("dist").alias("dist"), F.min(F.when(~F.col("new"), F.col("dist"))).alias("old"))
        before, best = best, materialize(least.select("src", "node", "dist", (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("new")), "path-round")
        discard(before)  # the states of one round lie on disk, not those of all
        if best.filter("new").limit(1).count() == 0:
            discard(adjacency)
            return best.select("src", "node", "dist")


def parents(dist: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(src, node, parent): the least neighbour on a shortest path; equality is exact as the same sum made dist."""
    up = dist.select("src", F.col("node").alias("a"), F.col("dist").alias("pd"))
    steps = up.join(adjacency, "a").join(dist.filter("dist > 0").select("src", F.col("node").alias("b"), "dist"), ["src", "b"])
    return steps.filter(F.col("pd") + F.col("w") == F.col("dist")).groupBy("src", F.col("b").alias("node")).agg(F.min("a").alias("parent"))


def depths(tree: DataFrame) -> DataFrame:
    """``tree`` (src, node, parent) with depth, the steps from the roots."""
    roots = tree.select("src", F.col("parent").alias("node")).join(tree.select("src", "node"), ["src", "node"], "left_anti").distinct()
    level = materialize(roots.withColumn("depth", F.lit(0)), "tree-level")
    done, depth = level, 0
    while True:
        depth += 1
        level = materialize(tree.join(level.select("src", F.col("node").alias("parent")), ["src", "parent"]).select("src", "node", F.lit(depth).alias("depth")), "tree-level")
        if level.limit(1).count() == 0:
            return tree.join(done, ["src", "node"])
        done = done.union(level)


def subtree_totals(tree: DataFrame, values: DataFrame, total) -> DataFrame:
    """(src, node, parent, total) with ``total`` (an aggregate of column v) over each node's subtree, deepest first."""
    deep = materialize(depths(tree), "tree-depths")
    last = deep.agg(F.max("depth").alias("d")).first()["d"] or 0
    rows = materialize(deep.join(values, ["src", "node"], "left").select("src", "node", "parent", "depth", "v"), "tree-values")
    out, carried = None, None
    for depth in range(last, 0, -1):
        level = rows.filter(F.col("depth") == depth).select("src", "node", "parent", "v")
        if carried is not None:
            level = level.union(carried.join(level.select("src", "node", "parent"), ["src", "node"]).select("src", "node", "parent", "v"))
        level = materialize(level.groupBy("src", "node", "parent").agg(total(F.col("v")).alias("v")), "tree-totals")
        out = level if out is None else out.union(level)
        carried = level.select("src", F.col("parent").alias("node"), "v")
    if out is None:
        out = rows.select("src", "node", "parent", "v").limit(0)
    return out.withColumnRenamed("v", "total")


def forced_cost(tree: DataFrame, adjacency: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, node, cost): other weights added along the tree's paths, pushed down level by level."""
    weights = adjacency.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("parent"), F.col("b").alias("node"), "w")
    steps = materialize(tree.join(weights, ["parent", "node"]), "forced-steps")
    level = materialize(roots.select("src", "node", F.lit(0.0).alias("cost")), "forced-level")
    done = level
    while True:
        level = materialize(steps.join(level.select("src", F.col("node").alias("parent"), "cost"), ["src", "parent"]).select("src", "node", (F.col("cost") + F.col("w")).alias("cost")), "forced-level")
        if level.limit(1).count() == 0:
            return done
        done = done.union(level)


def shortest_steps(dist: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(src, a, b): every step that lies on a shortest path from src; weights of 0 are no steps, so there is no cycle."""
    up = dist.select("src", F.col("node").alias("a"), F.col("dist").alias("pd"))
    steps = up.join(adjacency, "a").join(dist.select("src", F.col("node").alias("b"), "dist"), ["src", "b"])
    return steps.filter((F.col("w") > 0) & (F.col("pd") + F.col("w") == F.col("dist"))).select("src", "a", "b").distinct()


def flow(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(src, node, v): ``start`` (src, node, v) carried along ``steps`` (src, a, b) and summed wherever it passes.

    One round a hop; a round moves only what the round before it brought. ``steps`` has no cycle.
    """
    front = materialize(start.select("src", "node", "v"), "flow-front")
    passed = front
    while True:
        moved = steps.join(front.withColumnRenamed("node", "a"), ["src", "a"]).groupBy("src", F.col("b").alias("node")).agg(F.sum("v").alias("v"))
        front = materialize(moved, "flow-front")
        if front.limit(1).count() == 0:
            return passed.groupBy("src", "node").agg(F.sum("v").alias("v"))
        passed = passed.union(front)
