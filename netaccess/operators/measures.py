"""Weighted statistics, coverage and inequality as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators.ranking import grouped_upto, grouped_value_ranks, running_sum


def weighted_mean(value: str, weight: str) -> Column:
    """Rows without value or with a weight of 0 or less do not count; NULL when none counts."""
    counts = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(counts, F.col(value) * F.col(weight))), F.sum(F.when(counts, F.col(weight))))


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    out = {"mean": F.avg(value), "med": F.median(value), "q75": F.percentile(value, 0.75), "most": F.max(value)}
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.round(c, 5).alias(k) for k, c in out.items()))


def district_rollup(districts: DataFrame, key: str) -> DataFrame:
    """By country the 25 figures of its districts: counts, medians, means, sums, sample deviations, quartiles, most and the share of amplified ones.

    Loss of efficiency and amplification come from the district's own figures, null where they are not defined; such a
    district does not count in their means, but in the share of amplified ones. A group has one row a district.
    """
    loss = F.when(F.col("e_normal") > 0, (F.col("e_normal") - F.col("e_extreme")) / F.col("e_normal") * 100)
    rows = districts.withColumn("loss", loss).withColumn("amp", F.when(F.col("road_drop") > 0, F.col("loss") / F.col("road_drop")))
    q75 = lambda c: F.percentile(c, 0.75)
    mean = {"lcc_ratio": "lcc_ratio", "bridge_ratio": "bridge_ratio", "road_deg": "road_drop", "p_block": "p_block", "e_normal": "e_normal", "e_extreme": "e_extreme", "loss_pct": "loss", "d_normal": "d_normal", "d_extreme": "d_extreme", "new_parts": "new_parts", "amp": "amp", "q_c": "q_c", "fall_at_q_c": "fall_at_q_c"}
    more = {
        "nodes_median": F.median("n_nodes"), "edges_median": F.median("n_edges"), "road_deg_std": F.stddev_samp("road_drop"), "loss_pct_std": F.stddev_samp("loss"), "loss_pct_q75": q75("loss"),
        "amp_median": F.median("amp"), "amp_q75": q75("amp"), "amp_over_1_pct": F.avg(F.when(F.col("amp") > 1, 1.0).otherwise(0.0)) * 100, "q_c_median": F.median("q_c"),
    }
    return rows.groupBy(key).agg(
        F.count("district_id").alias("n_districts"), F.sum("n_critical").cast("bigint").alias("critical_total"), F.max("new_parts").cast("bigint").alias("new_parts_max"),
        *(F.round(F.avg(c), 5).alias(f"{k}_mean") for k, c in mean.items()), *(F.round(c, 5).alias(k) for k, c in more.items()),
    )


def od_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and ratios over all pairs, increases over connected ones, the severe share over all."""
    kind = lambda k: F.count_if(F.col("conn_type") == k)
    n, inc = F.count("*"), "increase_pct"
    return pairs.groupBy(*keys).agg(
        n.alias("n"), kind("connected").alias("n_connected"), F.round(F.try_divide(kind("climate_disconnected"), n), 6).alias("climate_ratio"), F.round(F.try_divide(kind("both_unreachable"), n), 6).alias("both_ratio"),
        F.round(F.avg(inc), 5).alias("mean"), F.round(F.median(inc), 5).alias("med"), F.round(F.percentile(inc, 0.75), 5).alias("q75"), F.round(F.try_divide(F.sum("severe_increase"), n), 6).alias("severe_share"),
    )


def weighted_stats(df: DataFrame, keys: list[str], value: str, weight: str, tie: str, quantiles: tuple[float, ...]) -> DataFrame:
    """Weighted mean and quantiles by group: the first value whose share of the weight so far reaches q."""
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    upto = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_upto", upto).withColumn("_total", total)
    cuts = [F.round(F.min(F.when(F.col("_upto") >= q * F.col("_total"), F.col(value))), 6).alias(f"p{int(q * 100)}") for q in quantiles]
    return rows.groupBy(*keys).agg(F.round(weighted_mean(value, weight), 6).alias("mean"), *cuts)


def weighted_quantiles_overall(df: DataFrame, value: str, weight: str, tie: str, quantiles: tuple[float, ...]) -> DataFrame:
    """As ``weighted_stats`` over the whole table, by ordered ranges."""
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    total = F.broadcast(rows.agg(F.sum(weight).alias("_total")))
    rows = running_sum(rows.select(value, weight, tie), [F.asc(value), F.asc(tie)], F.col(weight), "_upto").crossJoin(total)
    return rows.agg(*(F.round(F.min(F.when(F.col("_upto") >= q * F.col("_total"), F.col(value))), 6).alias(f"p{int(q * 100)}") for q in quantiles))


def isochrones(df: DataFrame, keys: list[str], hours: tuple[float, ...], inclusive: bool = False) -> DataFrame:
    """Population within each time limit in both scenarios, absolute and as a share."""
    out = []
    for h in hours:
        for short, t in (("n", "t_normal"), ("e", "t_extreme")):
            inside = F.col(t) <= h if inclusive else F.col(t) < h
            pop = F.coalesce(F.sum(F.when(inside, F.col("population"))), F.lit(0.0))
            out += [F.round(pop, 2).alias(f"{short}_{int(h * 60)}"), F.round(F.coalesce(F.try_divide(pop, F.sum("population")) * 100, F.lit(0.0)), 5).alias(f"p{short}_{int(h * 60)}")]
    return df.groupBy(*keys).agg(*out)


def gini(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    rows = df.filter(F.col(value) >= 0)
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie))
    n = F.count("*")
    g = 2 * F.try_divide(F.sum(F.col("_i") * F.col(value)), n * F.sum(value)) - (n + 1) / n
    return rows.withColumn("_i", i).groupBy(*keys).agg(F.round(g, 6).alias("gini"), n.alias("_n")).filter("_n >= 2").drop("_n")


def replicated_gini(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Gini of values each repeated round(weight / least weight) times, 1 to 500, without repeating a row."""
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    least = F.min(weight).over(Window.partitionBy(*keys))
    times = F.least(F.greatest(F.round(F.col(weight) / least), F.lit(1)), F.lit(500)).cast("bigint")
    c = rows.withColumn("_k", times).groupBy(*keys, value).agg(F.sum("_k").cast("double").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    k, n, tk = F.col("_k"), F.sum("_k"), F.sum(F.col(value) * F.col("_k"))
    g = 2 * F.sum(F.col(value) * k * (F.col("_upto") - (k - 1) / 2)) / (n * tk) - (n + 1) / n
    return c.withColumn("_upto", upto).groupBy(*keys).agg(F.round(g, 6).alias("gini"), n.cast("bigint").alias("n")).filter("n >= 10")


def inequality_bundle(df: DataFrame, key: str, t0: str, t1: str, weight: str, least: int = 10) -> DataFrame:
    """By ``key``: both Ginis, their difference, the rank correlation of t0 with the delay, its weighted P50 and P90, and their ratio.

    Rows need both times and a weight above 0; Ginis and correlation count each round(weight / least weight) times, 1 to 500. Groups of
    under ``least`` rows have null figures. Ranks come from counted values in ranges, so that a group may hold most rows.
    """
    rows = df.filter(F.col(t0).isNotNull() & F.col(t1).isNotNull() & (F.col(weight) > 0)).select(F.col(key), F.col(t0).alias("a"), F.col(t1).alias("b"), (F.col(t1) - F.col(t0)).alias("d"), F.col(weight).alias("w"))
    lightest = rows.groupBy(key).agg(F.min("w").alias("_m"), F.sum("w").alias("_all"), F.count("*").alias("_rows"))  # a row for each group
    rows = rows.join(F.broadcast(lightest), key).withColumn("k", F.least(F.greatest(F.bround(F.col("w") / F.col("_m")), F.lit(1)), F.lit(500)).cast("bigint"))
    for c in ("a", "b", "d"):
        rows = grouped_value_ranks(rows, [key], c, times=F.col("k")).withColumnRenamed("avg_rank", f"r{c}").drop("min_rank")
    k, n = F.col("k"), F.sum("k")
    total = lambda *c: F.sum(reduce(lambda x, y: x * F.col(y), c, k.cast("double")))
    gini = lambda c: 2 * total(c, f"r{c}") / (n * total(c)) - (n + 1) / n
    spread = lambda x, y: total(x, y) - total(x) * total(y) / n
    rho = F.try_divide(spread("ra", "rd"), F.sqrt(spread("ra", "ra") * spread("rd", "rd")))
    figures = rows.groupBy(key).agg(F.first("_rows").alias("n"), gini("a").alias("gini_normal"), gini("b").alias("gini_extreme"), rho.alias("spearman_rho"))
    reach = grouped_upto(rows, [key], "d", F.col("w")).join(F.broadcast(lightest.select(key, "_all")), key)
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("d")))
    out = figures.join(reach.groupBy(key).agg(at(0.5).alias("p50_delta"), at(0.9).alias("p90_delta")), key)
    enough = lambda c: F.when(F.col("n") >= least, c)
    return out.select(
        key, "n", *(enough(F.col(c)).alias(c) for c in ("gini_normal", "gini_extreme")), enough(F.col("gini_extreme") - F.col("gini_normal")).alias("delta_gini"), *(enough(F.col(c)).alias(c) for c in ("spearman_rho", "p50_delta", "p90_delta")),
        enough(F.when(F.col("p50_delta") > 0, F.col("p90_delta") / F.col("p50_delta"))).alias("tail_ratio"),
    )


def quadrants(df: DataFrame, name: str, x: str, y: str) -> DataFrame:
    """Groups above and below the medians of two measures, with their sorted members."""
    mid = F.broadcast(df.agg(F.median(x).alias("_mx"), F.median(y).alias("_my")))
    high_x, high_y = F.col(x) >= F.col("_mx"), F.col(y) >= F.col("_my")
    label = F.when(high_x & high_y, "HH").when(high_x, "HL").when(high_y, "LH").otherwise("LL")
    members = F.array_join(F.array_sort(F.collect_list(name)), ",")
    return df.crossJoin(mid).groupBy(label.alias("quadrant")).agg(F.count("*").alias("n"), members.alias("members"), F.round(F.avg(x), 5).alias("mean"), F.round(F.median(x), 5).alias("med"))


def moisture_stats(climate: DataFrame, value: str = "mrso") -> DataFrame:
    """For each cell the mean, the 75th and 95th percentile and the share of months at or under the former."""
    cut = climate.groupBy("cell_id").agg(F.percentile(value, 0.75).alias("p75"), F.percentile(value, 0.95).alias("p95"))
    rows = climate.join(cut, "cell_id")
    share = F.avg(F.when(F.col(value) <= F.col("p75"), 1.0).otherwise(0.0))
    return rows.groupBy("cell_id").agg(F.avg(value).alias("mean"), F.max("p75").alias("p75"), F.max("p95").alias("p95"), share.alias("share"))
