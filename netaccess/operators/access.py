"""Access to facilities and the buffering of a network, from twin shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.graph import paths as P
from netaccess.graph.build import both_ways
from netaccess.runtime import materialize


def starts_of(facilities: DataFrame) -> DataFrame:
    return facilities.select(F.lit(0).cast("bigint").alias("src"), (1_000_000 + F.col("facility_id")).alias("node"))


def forced_degradation(edges: DataFrame, facilities: DataFrame) -> DataFrame:
    """node, t_normal, direct_degradation: extreme cost along the normal tree less the normal time, at least 0."""
    starts, normal = starts_of(facilities), both_ways(edges, "w0")
    dist = materialize(P.shortest_paths(normal, starts), "forced-dist")
    tree = P.parents(dist, normal)
    cost = P.forced_cost(tree, both_ways(edges, "w1"), starts)
    return dist.join(cost, ["src", "node"]).select("node", F.col("dist").alias("t_normal"), F.greatest(F.col("cost") - F.col("dist"), F.lit(0.0)).alias("direct_degradation"))


def facility_access(edges: DataFrame, facilities: DataFrame) -> DataFrame:
    """node, t_normal, t_extreme, delta_t to the nearest facility; NULL where none is reached."""
    starts = starts_of(facilities)
    t0 = P.shortest_paths(both_ways(edges, "w0"), starts).select("node", F.col("dist").alias("t_normal"))
    t1 = P.shortest_paths(both_ways(edges, "w1"), starts).select("node", F.col("dist").alias("t_extreme"))
    return t0.join(t1, "node", "full").withColumn("delta_t", F.col("t_extreme") - F.col("t_normal"))


def buffering(edges: DataFrame, facilities: DataFrame) -> DataFrame:
    """Share of a node's forced delay that rerouting avoids: 1 - delta / forced, within 0 and 1."""
    forced = forced_degradation(edges, facilities).select("node", "direct_degradation")
    rows = facility_access(edges, facilities).join(forced, "node")
    delta, dd = F.col("delta_t"), F.col("direct_degradation")
    ratio = F.when(dd > 0, F.least(F.greatest(1 - delta / dd, F.lit(0.0)), F.lit(1.0))).otherwise(F.when(delta == 0, 1.0).otherwise(0.0))
    return rows.withColumn("buffering_ratio", ratio)
