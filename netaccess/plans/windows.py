"""Queries of ranks, cumulative shares, running values and smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators import ranking as K
from netaccess.plans.registry import query


@query("wn1_min_rank", "scores", sql="SELECT edge_id, CAST(rank() OVER (ORDER BY ni DESC) AS BIGINT) AS ni_rank FROM scores")
def min_rank(scores: DataFrame) -> DataFrame:
    return K.value_ranks(scores, "ni", descending=True).select("edge_id", F.col("min_rank").alias("ni_rank"))


AVG_RANK = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE"


@query("wn2_avg_pct_rank_desc", "scores", sql=f"SELECT edge_id, round(({AVG_RANK.format(x='cv DESC', v='cv')}) / count(*) OVER (), 6) AS pct FROM scores")
def pct_rank_desc(scores: DataFrame) -> DataFrame:
    n = F.broadcast(scores.agg(F.count("*").alias("n")))
    return K.value_ranks(scores, "cv", descending=True).crossJoin(n).select("edge_id", F.round(F.col("avg_rank") / F.col("n"), 6).alias("pct"))


@query("wn3_avg_pct_rank", "pixels", sql=f"SELECT pixel_id, round(({AVG_RANK.format(x='pop', v='pop')}) / count(*) OVER () * 100, 6) AS pct FROM pixels")
def pct_rank(pixels: DataFrame) -> DataFrame:
    n = F.broadcast(pixels.agg(F.count("pop").alias("n")))
    return K.value_ranks(pixels, "pop").crossJoin(n).select("pixel_id", F.round(F.col("avg_rank") / F.col("n") * 100, 6).alias("pct"))


@query("wn4_truncated_rank", "scores", sql=f"SELECT edge_id, CAST(floor({AVG_RANK.format(x='w0 DESC', v='w0')}) AS BIGINT) AS r FROM scores")
def truncated(scores: DataFrame) -> DataFrame:
    return K.value_ranks(scores, "w0", descending=True).select("edge_id", F.floor("avg_rank").alias("r"))


@query("wn5_ordinal", "access", sql="SELECT node_id, row_number() OVER (ORDER BY population DESC, node_id) AS rank FROM access")
def ordinal(access: DataFrame) -> DataFrame:
    return K.global_rank(access, [F.desc("population"), F.asc("node_id")]).select("node_id", "rank")


@query("wn6_inverted_order", "country", "access", sql="SELECT country, row_number() OVER (ORDER BY n DESC, country) AS r FROM (SELECT country, count(*) AS n FROM access a JOIN country c ON a.country_id = c.country_id GROUP BY country) t")
def inverted(country: DataFrame, access: DataFrame) -> DataFrame:
    n = access.join(country, "country_id").groupBy("country").agg(F.count("*").alias("n"))
    return K.global_rank(n, [F.desc("n"), F.asc("country")], "r").select("country", "r")


@query("wn7_percentile_groups", "access", sql="""WITH s AS (SELECT node_id, sum(population) OVER (PARTITION BY country_id ORDER BY t_normal, node_id) / sum(population) OVER (PARTITION BY country_id) AS share FROM access WHERE t_normal IS NOT NULL AND population > 0)
    SELECT node_id, CASE WHEN round(share, 9) BETWEEN 0.4 AND 0.6 THEN 'p50' WHEN round(share, 9) > 0.8 THEN 'p90' END AS grp FROM s""")
def percentile_groups(access: DataFrame) -> DataFrame:
    rows = access.filter("t_normal IS NOT NULL AND population > 0")
    upto = F.sum("population").over(Window.partitionBy("country_id").orderBy("t_normal", "node_id").rowsBetween(Window.unboundedPreceding, 0))
    share = F.round(upto / F.sum("population").over(Window.partitionBy("country_id")), 9)
    return rows.withColumn("share", share).select("node_id", F.when(F.col("share").between(0.4, 0.6), "p50").when(F.col("share") > 0.8, "p90").alias("grp"))


@query("wn8_first_per_key", "places", sql="SELECT country_id, place_id, featurecla FROM (SELECT *, row_number() OVER (PARTITION BY country_id ORDER BY featurecla, pop_max DESC, place_id) AS r FROM places) t WHERE r = 1")
def first_per_key(places: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("place_id", "featurecla"), F.struct("featurecla", -F.col("pop_max"), "place_id")).alias("b")
    return places.groupBy("country_id").agg(best).select("country_id", "b.place_id", "b.featurecla")


DAILY = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1"


def daily(events: DataFrame) -> DataFrame:
    """Thirty rows, whatever the number of events: the windows below run over these."""
    return events.groupBy(F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("s"))


@query("wn9_steepest_drop", "events", sql=f"WITH d AS (SELECT day, lead(n) OVER (ORDER BY day) - n AS step FROM ({DAILY}) t) SELECT arg_min(day, step * 1000 + CAST(extract(day FROM day) AS BIGINT)) AS day, min(step) AS step FROM d WHERE step IS NOT NULL")
def steepest(events: DataFrame) -> DataFrame:
    d = daily(events).select("day", (F.lead("n").over(Window.orderBy("day")) - F.col("n")).alias("step")).filter("step IS NOT NULL")
    return d.agg(F.min_by("day", F.struct("step", "day")).alias("day"), F.min("step").alias("step"))


@query("wn10_running_min", "events", sql=f"SELECT day, min(n) OVER (ORDER BY day) AS low FROM ({DAILY}) t")
def running_min(events: DataFrame) -> DataFrame:
    return daily(events).select("day", F.min("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("low"))


@query("wn11_gap_fill", "events", sql=f"""WITH d AS (SELECT row_number() OVER (ORDER BY day) AS i, CASE WHEN row_number() OVER (ORDER BY day) % 4 = 1 THEN s END AS s FROM ({DAILY}) t),
    w AS (SELECT i, s, max(CASE WHEN s IS NOT NULL THEN i END) OVER (ORDER BY i) AS i0, min(CASE WHEN s IS NOT NULL THEN i END) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM d)
    SELECT w.i, round(CASE WHEN w.i1 IS NULL OR w.i1 = w.i0 THEN a.s ELSE a.s + (b.s - a.s) * CAST(w.i - w.i0 AS DOUBLE) / (w.i1 - w.i0) END, 5) AS s FROM w LEFT JOIN d a ON w.i0 = a.i LEFT JOIN d b ON w.i1 = b.i""")
def gap_fill(events: DataFrame) -> DataFrame:
    """Linear between sampled days, flat after the last."""
    days = Window.orderBy("day")
    d = daily(events).withColumn("i", F.row_number().over(days).cast("bigint"))
    d = d.select("i", F.when(F.col("i") % 4 == 1, F.col("s")).alias("s"))
    back, ahead = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("s").isNotNull(), F.struct("i", "s"))
    d = d.select("i", F.last(at, True).over(back).alias("a"), F.first(at, True).over(ahead).alias("b"))
    slope = F.try_divide(F.col("b.s") - F.col("a.s"), F.col("b.i") - F.col("a.i"))
    return d.select("i", F.round(F.col("a.s") + F.coalesce(slope, F.lit(0.0)) * (F.col("i") - F.col("a.i")), 5).alias("s"))


@query("wn12_ecdf", "access", sql="SELECT node_id, round(100.0::DOUBLE * row_number() OVER (ORDER BY t_normal, node_id) / count(*) OVER (), 6) AS pct FROM access WHERE t_normal IS NOT NULL")
def ecdf(access: DataFrame) -> DataFrame:
    rows = access.filter("t_normal IS NOT NULL")
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    return K.global_rank(rows, [F.asc("t_normal"), F.asc("node_id")]).crossJoin(n).select("node_id", F.round(100 * F.col("rank") / F.col("n"), 6).alias("pct"))


@query("wn13_concentration", "scores", sql="""WITH s AS (SELECT sum(ni) OVER (ORDER BY ni DESC, edge_id) / sum(ni) OVER () AS share, CAST(row_number() OVER (ORDER BY ni DESC, edge_id) AS DOUBLE) / count(*) OVER () AS x FROM scores WHERE ni > 0)
    SELECT round(max(CASE WHEN x <= 0.1 THEN share END), 6) AS top_tenth FROM s""")
def concentration(scores: DataFrame) -> DataFrame:
    rows = scores.filter("ni > 0").select("edge_id", "ni")
    total = F.broadcast(rows.agg(F.count("*").alias("n"), F.sum("ni").alias("total")))
    order = [F.desc("ni"), F.asc("edge_id")]
    parts = K.ordered_ranges(rows, order)
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_n", F.row_number().over(own)).withColumn("_s", F.sum("ni").over(own))
    seen, held = K.offsets(parts, F.lit(1)), K.offsets(parts, F.col("ni")).withColumnRenamed("_before", "_held")
    rows = parts.join(seen, "_part").join(held, "_part").crossJoin(total)
    share = F.when((F.col("_before") + F.col("_n")) / F.col("n") <= 0.1, (F.col("_held") + F.col("_s")) / F.col("total"))
    return rows.agg(F.round(F.max(share), 6).alias("top_tenth"))


@query("wn14_kernel", "events", sql=f"SELECT day, round((coalesce(lag(s, 2) OVER w, 0) + 2 * coalesce(lag(s, 1) OVER w, 0) + 3 * s + 2 * coalesce(lead(s, 1) OVER w, 0) + coalesce(lead(s, 2) OVER w, 0)) / 9, 5) AS smooth FROM ({DAILY}) t WINDOW w AS (ORDER BY day)")
def kernel(events: DataFrame) -> DataFrame:
    w = Window.orderBy("day")
    near = lambda k: F.coalesce(F.lag("s", k).over(w), F.lit(0.0))
    return daily(events).select("day", F.round((near(2) + 2 * near(1) + 3 * F.col("s") + 2 * near(-1) + near(-2)) / 9, 5).alias("smooth"))


@query("wn15_row_id", "places", sql="SELECT place_id, row_number() OVER (PARTITION BY country_id ORDER BY place_id) - 1 AS row_id FROM places")
def row_id(places: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("country_id").orderBy("place_id")).cast("bigint") - 1
    return places.select("place_id", n.alias("row_id"))
