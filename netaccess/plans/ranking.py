"""Queries of sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.operators import sets as S
from netaccess.operators.ranking import quantiles
from netaccess.plans.registry import query


@query("tk1_nlargest", "scores", sql="SELECT edge_id, ni FROM scores ORDER BY ni DESC, edge_id LIMIT 500")
def nlargest(scores: DataFrame) -> DataFrame:
    return S.top_k(scores, "ni", "edge_id", C.TOP_K).select("edge_id", "ni")


@query("tk3_multi_key_sort", "od", sql="SELECT city_a, city_b, country_a FROM od ORDER BY country_a DESC, t0 ASC NULLS LAST, city_a, city_b LIMIT 100")
def multi_key(od: DataFrame) -> DataFrame:
    return od.orderBy(F.desc("country_a"), F.asc_nulls_last("t0"), "city_a", "city_b").limit(100).select("city_a", "city_b", "country_a")


@query("tk4_priority_order", "scores", sql="SELECT edge_id, row_number() OVER (ORDER BY ni * cv DESC, edge_id) AS priority FROM scores")
def priority(scores: DataFrame) -> DataFrame:
    from netaccess.operators.ranking import global_rank

    return global_rank(scores.select("edge_id", (F.col("ni") * F.col("cv")).alias("s")), [F.desc("s"), F.asc("edge_id")], "priority").select("edge_id", "priority")


@query("tk5_head", "country", "roads", sql="SELECT country, count(*) AS n FROM roads r JOIN country c ON r.country_id = c.country_id GROUP BY country ORDER BY n DESC, country LIMIT 10")
def head(country: DataFrame, roads: DataFrame) -> DataFrame:
    return roads.join(country, "country_id").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(10)


@query("tk6_top_then_sorted", "access", sql="SELECT * FROM (SELECT node_id, round(t_extreme - t_normal, 6) AS d FROM access WHERE t_extreme IS NOT NULL ORDER BY d DESC, node_id LIMIT 20) t ORDER BY d, node_id")
def top_sorted(access: DataFrame) -> DataFrame:
    d = access.filter("t_extreme IS NOT NULL").select("node_id", F.round(F.col("t_extreme") - F.col("t_normal"), 6).alias("d"))
    return d.orderBy(F.desc("d"), "node_id").limit(20).orderBy("d", "node_id")


@query("tk7_budget_prefix", "scores", sql="SELECT f AS fraction, CAST(round_even(f * n, 0) AS BIGINT) AS n_edges FROM (SELECT count(*) AS n FROM scores) t, (VALUES " + ", ".join(f"({f}::DOUBLE)" for f in C.PAVING_FRACTIONS) + ") x(f)")
def budget(scores: DataFrame) -> DataFrame:
    f = F.explode(F.array(*map(F.lit, C.PAVING_FRACTIONS)))
    return scores.agg(F.count("*").alias("n")).select("n", f.alias("fraction")).select("fraction", F.bround(F.col("fraction") * F.col("n")).cast("bigint").alias("n_edges"))


@query("st1_union_by_name", "places", "facilities", sql="SELECT place_id AS id, name, NULL::VARCHAR AS amenity, pop_max FROM places UNION ALL SELECT facility_id, name, amenity, NULL FROM facilities")
def union(places: DataFrame, facilities: DataFrame) -> DataFrame:
    a = places.select(F.col("place_id").alias("id"), "name", "pop_max")
    return a.unionByName(facilities.select("amenity", "name", F.col("facility_id").alias("id")), allowMissingColumns=True)


@query("st2_distinct_rounded", "pixels", sql="SELECT DISTINCT round(lon, 1) AS lon, round(lat, 0) AS lat FROM pixels")
def distinct(pixels: DataFrame) -> DataFrame:
    return pixels.select(F.round("lon", 1).alias("lon"), F.round("lat", 0).alias("lat")).distinct()


@query("st3_road_tiers", "scores", sql="""WITH q AS (SELECT quantile_cont(ni, 0.8) AS q80, quantile_cont(ni, 0.9) AS q90, quantile_cont(ni, 0.95) AS q95 FROM scores)
    SELECT tier, count(*) AS n FROM (SELECT CASE WHEN w0 >= 48 AND ni >= q90 THEN 'L1' WHEN w0 >= 48 OR ni >= q95 THEN 'L2' WHEN ni >= q80 THEN 'L3' END AS tier FROM scores, q) t WHERE tier IS NOT NULL GROUP BY tier""")
def tiers(scores: DataFrame) -> DataFrame:
    return S.road_tiers(scores, F.col("w0") >= 48, "ni").groupBy("tier").agg(F.count("*").alias("n"))


@query("st4_jaccard", "scores", sql="WITH a AS (SELECT edge_id FROM scores ORDER BY ni DESC, edge_id LIMIT 500), b AS (SELECT edge_id FROM scores ORDER BY ni * (1 + cv) DESC, edge_id LIMIT 500) SELECT round(CAST(count(*) FILTER (WHERE a.edge_id IS NOT NULL AND b.edge_id IS NOT NULL) AS DOUBLE) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.edge_id = b.edge_id")
def jaccard(scores: DataFrame) -> DataFrame:
    a = S.top_k(scores, "ni", "edge_id", C.TOP_K)
    b = S.top_k(scores.withColumn("s", F.col("ni") * (1 + F.col("cv"))), "s", "edge_id", C.TOP_K)
    return S.jaccard(a, b, ["edge_id"])


@query("st5_intersection", "places", "facilities", sql="SELECT place_id FROM places WHERE pop_max > 100000 INTERSECT SELECT facility_id FROM facilities")
def intersection(places: DataFrame, facilities: DataFrame) -> DataFrame:
    return places.filter("pop_max > 100000").select("place_id").intersect(facilities.select("facility_id"))


@query("st6_difference", "places", "facilities", sql="SELECT place_id FROM places WHERE pop_max > 100000 EXCEPT SELECT facility_id FROM facilities")
def difference(places: DataFrame, facilities: DataFrame) -> DataFrame:
    return places.filter("pop_max > 100000").join(facilities, F.col("place_id") == F.col("facility_id"), "left_anti").select("place_id").distinct()


@query("st7_retention", "scores", sql="WITH m AS (SELECT median(ni) AS a, median(cv) AS b FROM scores) SELECT round(CAST(count(*) FILTER (WHERE ni >= a AND cv >= b) AS DOUBLE) / nullif(count(*) FILTER (WHERE ni >= a), 0), 6) AS retention FROM scores, m")
def retention(scores: DataFrame) -> DataFrame:
    m = F.broadcast(quantiles(scores, {"a": (F.col("ni"), (0.5,)), "b": (F.col("cv"), (0.5,))}))
    return S.retention(scores.crossJoin(m), F.col("ni") >= F.col("a_0"), F.col("cv") >= F.col("b_0"))
