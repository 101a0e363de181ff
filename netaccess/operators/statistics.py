"""Rank correlation, least squares from sums, and regression lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from netaccess.operators.ranking import value_ranks
from netaccess.runtime import materialize


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho and n over rows with both values: the correlation of average ranks."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = value_ranks(rows, x).withColumnRenamed("avg_rank", "_rx").drop("min_rank")
    ranked = value_ranks(ranked, y).withColumnRenamed("avg_rank", "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, h = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)), 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_p_value(t: float, df: int) -> float:
    """Two-sided p of Student's t."""
    return beta_tail(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def plane_fits(df: DataFrame, keys: list[str], x: str, z: str, y: str, least: int = 4) -> DataFrame:
    """By ``keys`` the least-squares fit y = b0 + b1 x + b2 z: coefficients, standard errors, t values, r2 and n.

    All groups come from one aggregation of means and products about them, solved in columns. Rows without one of the three do not
    count; groups of under ``least`` rows, or whose predictors lie on a line, have no row.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(z).isNotNull() & F.col(y).isNotNull())
    cov = {f"_{a}{b}": F.covar_pop(c, d) for (a, c), (b, d) in ((("x", x), ("x", x)), (("z", z), ("z", z)), (("y", y), ("y", y)), (("x", x), ("z", z)), (("x", x), ("y", y)), (("z", z), ("y", y)))}
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_m{k}") for k, c in (("x", x), ("z", z), ("y", y))), *(c.alias(k) for k, c in cov.items()))
    c = F.col
    det = c("_xx") * c("_zz") - c("_xz") * c("_xz")
    s = s.withColumn("_det", det).filter((c("n") >= least) & (c("_det") > 1e-12 * c("_xx") * c("_zz")))
    s = s.withColumn("b1", (c("_zz") * c("_xy") - c("_xz") * c("_zy")) / c("_det")).withColumn("b2", (c("_xx") * c("_zy") - c("_xz") * c("_xy")) / c("_det"))
    s = s.withColumn("b0", c("_my") - c("b1") * c("_mx") - c("b2") * c("_mz")).withColumn("_s2", F.greatest(c("_yy") - c("b1") * c("_xy") - c("b2") * c("_zy"), F.lit(0.0)) / (c("n") - 3))
    s = s.withColumns(
        {
            "se0": F.sqrt(c("_s2") * (1 + (c("_mx") * c("_mx") * c("_zz") - 2 * c("_mx") * c("_mz") * c("_xz") + c("_mz") * c("_mz") * c("_xx")) / c("_det"))),
            "se1": F.sqrt(c("_s2") * c("_zz") / c("_det")),
            "se2": F.sqrt(c("_s2") * c("_xx") / c("_det")),
            "r2": F.try_divide(c("b1") * c("_xy") + c("b2") * c("_zy"), c("_yy")),
        }
    )
    return s.select(*keys, "n", "b0", "b1", "b2", "se0", "se1", "se2", *(F.try_divide(c(f"b{k}"), c(f"se{k}")).alias(f"t{k}") for k in range(3)), "r2")


def two_sided_p(t: str, df: Column) -> Column:
    """Student's two-sided p, for tables of models."""
    return F.pandas_udf(p_values, DoubleType())(t, df)


def p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, int(b)) if a == a and b == b else None for a, b in zip(t, df)], dtype="float64")


def standardised(df: DataFrame, column: str, dims: int) -> DataFrame:
    """``df`` with every entry of an array less its mean and over its population deviation; entries that do not vary become 0."""
    at = lambda k: F.get(column, F.lit(k)).cast("double")
    stats = df.agg(F.array(*(F.avg(at(k)) for k in range(dims))).alias("_mean"), F.array(*(F.stddev_pop(at(k)) for k in range(dims))).alias("_std"))
    scaled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_divide(F.get(column, k).cast("double") - F.get("_mean", k), F.get("_std", k)), F.lit(0.0)))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, scaled).drop("_mean", "_std")  # one row of as many numbers as dimensions


def clusters(df: DataFrame, key: str, column: str, k: int, restarts: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """((key, cluster), cost): the k-means labels of the cheapest of ``restarts`` starts, numbered by falling size, then first entry of the centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = materialize(df.select(key, array_to_vector(column).alias("features")), "cluster-rows")
    fits = [KMeans(k=k, seed=seed + i, tol=1e-6, maxIter=100).fit(rows) for i in range(restarts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    sizes = best.summary.clusterSizes
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], float(best.clusterCenters()[i][0])))
    place = F.array(*(F.lit(order.index(i)) for i in range(len(sizes))))
    return best.transform(rows).select(key, F.get(place, F.col("prediction")).alias("cluster")), float(best.summary.trainingCost)


def least_squares(df: DataFrame, predictors: list[str], target: str) -> dict:
    """Coefficients (intercept first), standard errors, p-values, R2 and n; only sums of products leave Spark."""
    names = ["_one", *predictors]
    rows = df.withColumn("_one", F.lit(1.0)).dropna(subset=[*predictors, target])
    sums = {f"x{i}_{j}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    sums |= {f"y{i}": F.sum(F.col(a) * F.col(target)) for i, a in enumerate(names)} | {"yy": F.sum(F.col(target) * F.col(target))}
    s = rows.agg(*(c.alias(k) for k, c in sums.items())).first()
    k = len(names)
    xx = np.array([[s[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    xy = np.array([s[f"y{i}"] for i in range(k)], float)
    beta = np.linalg.solve(xx, xy)
    n = xx[0, 0]
    rss = float(s["yy"] - beta @ xy)
    se = np.sqrt(np.maximum(0, rss / max(1.0, n - k)) * np.diag(np.linalg.inv(xx)))
    return {"beta": beta.tolist(), "se": se.tolist(), "p": [t_p_value(b / e, int(n) - k) if e > 0 else 0.0 for b, e in zip(beta, se)], "r2": 1 - rss / float(s["yy"] - xy[0] ** 2 / n), "n": int(n)}
