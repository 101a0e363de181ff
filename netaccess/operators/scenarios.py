"""Scenario, stability and sensitivity forms over edge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.operators.ranking import value_ranks


def score_variants(df: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """edge_id, variant, alpha, score: raw product, normalised product and additive forms for each exponent."""
    most = F.broadcast(df.agg(F.max("ni").alias("_ni"), F.max("cv").alias("_cv")))
    rows = df.crossJoin(most).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    ni, cv = F.try_divide("ni", "_ni"), F.try_divide("cv", "_cv")
    forms = F.explode(F.array(
        F.struct(F.lit("raw").alias("variant"), (F.pow("ni", F.col("alpha") / 2) * F.col("cv")).alias("score")),
        F.struct(F.lit("product").alias("variant"), (F.pow(ni, F.col("alpha") / 2) * cv).alias("score")),
        F.struct(F.lit("additive").alias("variant"), (F.pow(ni, F.col("alpha") / 2) + cv).alias("score")),
    )).alias("f")
    return rows.select("edge_id", "alpha", forms).select("edge_id", "f.variant", "alpha", "f.score")


def rank_sum(df: DataFrame) -> DataFrame:
    """edge_id and the sum of its descending percentile ranks of importance and slow-down."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    a = value_ranks(df.select("edge_id", "ni", "cv"), "ni", True).withColumnRenamed("avg_rank", "_a").drop("min_rank")
    b = value_ranks(a, "cv", True).withColumnRenamed("avg_rank", "_b")
    return b.crossJoin(n).select("edge_id", ((F.col("_a") + F.col("_b")) / F.col("_n")).alias("rank_sum"))


def future_slowdown(v0: Column, v1: Column, p: Column) -> Column:
    """Relative slow-down from a scenario's speeds, each factor floored, at least 0."""
    return F.greatest(F.greatest(v0, F.lit(0.5)) / (F.greatest(v1, F.lit(0.5)) * (1 - F.least(F.greatest(p, F.lit(0.0)), F.lit(0.99)))) - 1, F.lit(0.0))


def bottleneck_load(df: DataFrame, ni: str, cv: str, name: str) -> DataFrame:
    """``df`` with the product of importance and slow-down, each divided by its largest value that counts and kept in 0 to 1."""
    most = F.broadcast(df.agg(F.max(F.when(F.col(ni) > 0, F.col(ni))).alias("_ni"), F.max(F.when(F.col(cv) > C.CV_MIN, F.col(cv))).alias("_cv")))
    share = lambda c, m: F.coalesce(F.least(F.greatest(F.try_divide(F.col(c), F.col(m)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return df.crossJoin(most).withColumn(name, share(ni, "_ni") * share(cv, "_cv")).drop("_ni", "_cv")


def capture_share(df: DataFrame, order: Column, value: str, k: int) -> DataFrame:
    """Share of the total of ``value`` held by the first k rows in an order, beside k / n."""
    top = df.orderBy(order, "edge_id").limit(k).agg(F.sum(value).alias("_top"))
    return df.agg(F.sum(value).alias("_all"), F.count("*").alias("n")).crossJoin(F.broadcast(top)).select(F.round(F.try_divide("_top", "_all"), 6).alias("share"), F.round(F.lit(k) / F.col("n"), 6).alias("expected"))


def patched_access(od: DataFrame, edges_per_step: DataFrame) -> DataFrame:
    """Accessibility for each paving step from pair times patched by the relief of the edges paved so far."""
    steps = od.crossJoin(F.broadcast(edges_per_step))
    t = F.col("t1") - (F.col("t1") - F.col("t0")) * F.col("relief")
    return steps.groupBy("fraction", "n_edges").agg(F.sum(F.col("mass") / t).alias("a"))

