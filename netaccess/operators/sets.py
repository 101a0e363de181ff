"""Top-k with a fixed tie rule, and set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.operators.ranking import quantiles


def top_k(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k rows of largest value, ties to the lesser id."""
    return df.orderBy(F.desc(value), F.asc(tie)).limit(k)


def jaccard(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Shared over all distinct keys; two empty sets are alike."""
    left, right = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return left.join(right, on, "full").agg(F.round(F.coalesce(F.try_divide(both, F.count("*")), F.lit(1.0)), 6).alias("jaccard"))


def retention(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Share of the rows in the first mask that are in both; NULL when the first is empty."""
    return df.agg(F.round(F.try_divide(F.count_if(before & after), F.count_if(before)), 6).alias("retention"))


def road_tiers(df: DataFrame, bridge: Column, value: str) -> DataFrame:
    """L1: bridges in the top tenth; L2: other bridges and the top twentieth; L3: the rest of the top fifth."""
    q = F.broadcast(quantiles(df, {"_q": (F.col(value), (0.8, 0.9, 0.95))}))
    x = F.col(value)
    tier = F.when(bridge & (x >= F.col("_q_1")), "L1").when(bridge | (x >= F.col("_q_2")), "L2").when(x >= F.col("_q_0"), "L3")
    return df.crossJoin(q).withColumn("tier", tier).filter("tier IS NOT NULL").drop("_q_0", "_q_1", "_q_2")
