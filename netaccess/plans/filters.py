"""Queries of projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.functions import rules as R
from netaccess.operators.ranking import quantiles
from netaccess.plans.registry import query

BOXES = [("north", 0.0, 10.0, 12.0, 20.0), ("west", 0.0, 8.0, 0.0, 14.0), ("centre", 6.0, 14.0, 4.0, 12.0), ("east", 12.0, 20.0, 0.0, 16.0)]


@query("pf1_unpaved_roads", "roads", sql="SELECT road_id, surface, length_km FROM roads WHERE coalesce(lower(surface) LIKE '%unpaved%', false)")
def unpaved(roads: DataFrame) -> DataFrame:
    return roads.filter(R.is_unpaved(F.col("surface"))).select("road_id", "surface", "length_km")


@query("pf2_optional_surface", "roads", sql="SELECT coalesce(surface, 'unpaved') AS surface, count(*) AS n FROM roads GROUP BY 1")
def optional_surface(roads: DataFrame, surface: str = "") -> DataFrame:
    kept = roads.filter(F.lower("surface").contains(surface.lower())) if surface else roads
    return kept.groupBy(F.coalesce("surface", F.lit("unpaved")).alias("surface")).agg(F.count("*").alias("n"))


@query("pf3_min_length", "roads", sql="SELECT country_id, count(*) AS n FROM roads WHERE length_km >= 25 GROUP BY country_id")
def min_length(roads: DataFrame, km: float = 25) -> DataFrame:
    return roads.filter(F.col("length_km") >= km).groupBy("country_id").agg(F.count("*").alias("n"))


@query("pf4_membership", "places", sql="SELECT place_id, featurecla, featurecla NOT IN ('Admin-0 capital') AS not_capital FROM places WHERE country_id IN (1, 3, 5, 7, 11)")
def membership(places: DataFrame) -> DataFrame:
    return places.filter(F.col("country_id").isin(1, 3, 5, 7, 11)).select("place_id", "featurecla", (~F.col("featurecla").isin("Admin-0 capital")).alias("not_capital"))


@query("pf5_place_level", "places", sql="""SELECT * FROM (SELECT place_id, CASE WHEN featurecla LIKE 'Admin-0%' THEN 'capital' WHEN featurecla LIKE 'Admin-1%' THEN 'regional'
    WHEN pop_max >= 300000 THEN 'city' END AS level FROM places) t WHERE level IS NOT NULL""")
def levels(places: DataFrame, threshold: int = 300_000) -> DataFrame:
    return places.select("place_id", R.place_level(F.col("featurecla"), F.col("pop_max"), threshold).alias("level")).filter("level IS NOT NULL")


@query("pf6_reachable_populated", "access", sql="SELECT node_id, t_normal, t_extreme FROM access WHERE t_normal IS NOT NULL AND t_extreme IS NOT NULL AND t_normal < 1000000 AND population > 0")
def reachable(access: DataFrame, unreachable: float = 1e6) -> DataFrame:
    return access.filter((R.finite(F.col("t_normal")) < unreachable) & R.finite(F.col("t_extreme")).isNotNull() & (F.col("population") > 0)).select("node_id", "t_normal", "t_extreme")


OD_TYPE = "CASE WHEN t0 IS NULL AND t1 IS NULL THEN 'both_unreachable' WHEN t0 IS NULL THEN 'normal_unreachable' WHEN t1 IS NULL THEN 'climate_disconnected' ELSE 'connected' END"
OD_INC = "CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL AND t0 > 0 THEN (t1 - t0) / t0 * 100 END"


def od_pairs(od: DataFrame) -> DataFrame:
    """Origin-destination pairs with connection type, percentage increase and severe flag."""
    t0, t1 = F.col("t0"), F.col("t1")
    return od.withColumn("conn_type", R.connection_type(t0, t1)).withColumn("increase_pct", R.pct_increase(t0, t1)).withColumn("severe_increase", R.severe(F.col("increase_pct")))


OD_SQL = f"SELECT *, {OD_TYPE} AS conn_type, {OD_INC} AS increase_pct, CASE WHEN {OD_INC} >= 50 THEN 1 ELSE 0 END AS severe_increase FROM od"


@query("pf7_conn_type", "od", sql=f"SELECT {OD_TYPE} AS conn_type, count(*) AS n FROM od GROUP BY 1")
def conn_type(od: DataFrame) -> DataFrame:
    return od_pairs(od).groupBy("conn_type").agg(F.count("*").alias("n"))


@query("pf8_pct_increase", "od", sql=f"SELECT city_a, city_b, round({OD_INC}, 6) AS increase_pct FROM od")
def increase(od: DataFrame) -> DataFrame:
    return od_pairs(od).select("city_a", "city_b", F.round("increase_pct", 6).alias("increase_pct"))


@query("pf9_severe", "od", sql=f"SELECT severe_increase, count(*) AS n FROM ({OD_SQL}) t GROUP BY severe_increase")
def severe(od: DataFrame) -> DataFrame:
    return od_pairs(od).groupBy("severe_increase").agg(F.count("*").alias("n"))


@query("pf10_block_probability", "roads", sql="""SELECT road_id, greatest(v_normal, 0.01) AS v_normal,
    round(least(greatest(1 - least(greatest(pass_extreme, 0), 1), 0), 0.99), 6) AS p_block FROM roads""")
def block(roads: DataFrame) -> DataFrame:
    p = R.block_probability(F.col("pass_extreme"), F.col("v_normal"), F.col("v_extreme"))
    return roads.select("road_id", F.greatest("v_normal", F.lit(0.01)).alias("v_normal"), F.round(p, 6).alias("p_block"))


@query("pf11_speed_drop", "roads", sql="SELECT road_id, round(CASE WHEN v_normal > 0 THEN (v_normal - v_extreme) / v_normal * 100 END, 6) AS delta_v_pct FROM roads")
def drop(roads: DataFrame) -> DataFrame:
    return roads.select("road_id", F.round(R.speed_drop_pct(F.col("v_normal"), F.col("v_extreme")), 6).alias("delta_v_pct"))


@query("pf12_first_box", "places", sql="SELECT place_id, CASE " + " ".join(f"WHEN lon BETWEEN {a} AND {b} AND lat BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in BOXES) + " ELSE 'Other' END AS zone FROM places")
def box(places: DataFrame) -> DataFrame:
    return places.select("place_id", R.first_box(F.col("lon"), F.col("lat"), BOXES).alias("zone"))


@query("pf13_step_class", "od", sql=f"SELECT city_a, city_b, CASE WHEN x < 5 THEN 0 WHEN x < 10 THEN 1 WHEN x < 15 THEN 2 WHEN x < 20 THEN 3 WHEN x IS NOT NULL THEN 4 END AS bin FROM (SELECT city_a, city_b, {OD_INC} AS x FROM od) t")
def bins(od: DataFrame) -> DataFrame:
    return od_pairs(od).select("city_a", "city_b", R.step_class(F.col("increase_pct"), [5, 10, 15, 20]).alias("bin"))


@query("pf14_range_counts", "od", sql=f"""SELECT count(*) FILTER (WHERE x > 0 AND x <= 1) AS n_0_1, count(*) FILTER (WHERE x > 1 AND x <= 5) AS n_1_5,
    count(*) FILTER (WHERE x > 5 AND x <= 10) AS n_5_10, count(*) FILTER (WHERE x > 10 AND x <= 20) AS n_10_20, count(*) FILTER (WHERE x > 20) AS n_over_20 FROM (SELECT {OD_INC} AS x FROM od) t""")
def range_counts(od: DataFrame) -> DataFrame:
    x = F.col("increase_pct")
    cuts = [(0, 1), (1, 5), (5, 10), (10, 20)]
    return od_pairs(od).agg(*(F.count_if((x > a) & (x <= b)).alias(f"n_{a}_{b}") for a, b in cuts), F.count_if(x > 20).alias("n_over_20"))


@query("pf16_valid_split", "access", sql="SELECT coalesce(t_extreme > 0, false) AS valid, count(*) AS n FROM access GROUP BY 1")
def valid_split(access: DataFrame) -> DataFrame:
    return access.groupBy(F.coalesce(F.col("t_extreme") > 0, F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


@query("pf17_unit_scale", "roads", sql="""SELECT road_id, round(pass_extreme * (SELECT CASE WHEN min(pass_extreme) >= 0 AND max(pass_extreme) <= 1 THEN 100 WHEN min(pass_extreme) >= 0 AND max(pass_extreme) <= 100 THEN 1 END FROM roads), 6) AS pct FROM roads""")
def unit_scale(roads: DataFrame) -> DataFrame:
    x = F.col("pass_extreme")
    scale = roads.agg(F.when((F.min(x) >= 0) & (F.max(x) <= 1), 100).when((F.min(x) >= 0) & (F.max(x) <= 100), 1).otherwise(F.raise_error(F.lit("values are outside 0 to 100"))).alias("scale"))
    return roads.crossJoin(F.broadcast(scale)).select("road_id", F.round(x * F.col("scale"), 6).alias("pct"))


@query("pf19_nearest_key", "access", sql="SELECT country_id, arg_min(node_id, abs(t_normal - 0.5) * 1e6 + CAST(node_id AS DOUBLE) / 1e9) AS node_id FROM access WHERE abs(t_normal - 0.5) <= 0.3 GROUP BY country_id")
def nearest_key(access: DataFrame, target: float = 0.5, tolerance: float = 0.3) -> DataFrame:
    gap = F.abs(F.col("t_normal") - target)
    return access.filter(gap <= tolerance).groupBy("country_id").agg(F.min_by("node_id", gap * 1e6 + F.col("node_id").cast("double") / 1e9).alias("node_id"))


@query("pf20_neutral_edges", "edges", sql="SELECT abs(w0 - w1) <= 1e-12 + 1e-10 * abs(w1) AS neutral, count(*) AS n FROM edges GROUP BY 1")
def neutral(edges: DataFrame) -> DataFrame:
    return edges.groupBy(R.neutral(F.col("w0"), F.col("w1")).alias("neutral")).agg(F.count("*").alias("n"))


@query("pf21_outlier_trim", "access", sql="""SELECT node_id FROM access, (SELECT quantile_cont(t_normal, 0.99) AS a, quantile_cont(t_extreme, 0.99) AS b, quantile_cont(population, 0.99) AS c FROM access) q
    WHERE t_normal <= a AND t_extreme <= b AND population <= c""")
def trim(access: DataFrame, q: float = 0.99) -> DataFrame:
    names = ("t_normal", "t_extreme", "population")
    cut = quantiles(access, {n: (F.col(n), (q,)) for n in names})
    kept = access.crossJoin(F.broadcast(cut))
    for n in names:
        kept = kept.filter(F.col(n) <= F.col(f"{n}_0"))
    return kept.select("node_id")


@query("pf22_exclude_and_fill", "access", sql="SELECT node_id, coalesce(round(t_extreme / nullif(t_normal, 0), 6), 1.0) AS ratio FROM access WHERE country_id <> 3")
def exclude_fill(access: DataFrame, country_id: int = 3) -> DataFrame:
    ratio = F.coalesce(F.round(F.try_divide("t_extreme", "t_normal"), 6), F.lit(1.0))
    return access.filter(F.col("country_id") != country_id).select("node_id", ratio.alias("ratio"))


@query("pf23_safe_numeric", "events", sql="SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, ':\\s*([0-9.]+)', 1) AS DOUBLE), 0.0) AS k FROM events")
def safe_numeric(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.coalesce(R.finite(F.regexp_extract("props", r":\s*([0-9.]+)", 1)), F.lit(0.0)).alias("k"))


@query("pf24_term_filter", "facilities", sql="SELECT facility_id FROM facilities WHERE regexp_matches(concat_ws(' ', lower(coalesce(amenity, '')), lower(name)), 'hospital|clinic')")
def terms(facilities: DataFrame, words: tuple[str, ...] = ("hospital", "clinic")) -> DataFrame:
    text = F.concat_ws(" ", F.lower(F.coalesce("amenity", F.lit(""))), F.lower("name"))
    return facilities.filter(text.rlike("|".join(words))).select("facility_id")


@query("pf25_cross_country", "od", sql="SELECT country_a <> country_b AS cross_country, count(*) AS n FROM od GROUP BY 1")
def cross_country(od: DataFrame) -> DataFrame:
    return od.groupBy((F.col("country_a") != F.col("country_b")).alias("cross_country")).agg(F.count("*").alias("n"))


@query("pf26_coverage_drops", "access", sql="SELECT country_id, " + ", ".join(f"round((sum(CASE WHEN t_normal < {h} THEN population ELSE 0 END) - sum(CASE WHEN t_extreme < {h} THEN population ELSE 0 END)) / sum(population) * 100, 5) AS drop_{int(h * 60)}min" for h in C.ISOCHRONE_HOURS) + " FROM access GROUP BY country_id HAVING sum(population) > 0")
def coverage_drops(access: DataFrame) -> DataFrame:
    within = lambda t, h: F.sum(F.when(F.col(t) < h, F.col("population")).otherwise(0.0))
    total = F.sum("population")
    drops = [F.round((within("t_normal", h) - within("t_extreme", h)) / total * 100, 5).alias(f"drop_{int(h * 60)}min") for h in C.ISOCHRONE_HOURS]
    return access.groupBy("country_id").agg(total.alias("total"), *drops).filter("total > 0").drop("total")


@query("pf15_priority_tiers", "scores", sql="""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN r <= greatest(1, CAST(floor(n * 0.01) AS BIGINT)) THEN 1 WHEN r <= CAST(floor(n * 0.05) AS BIGINT) THEN 2 WHEN r <= CAST(floor(n * 0.2) AS BIGINT) THEN 3 WHEN r <= CAST(floor(n * 0.5) AS BIGINT) THEN 4 ELSE 5 END AS tier
    FROM (SELECT row_number() OVER (ORDER BY ni * cv DESC, edge_id) AS r, count(*) OVER () AS n FROM scores) t) s GROUP BY tier""")
def priority_tiers(scores: DataFrame) -> DataFrame:
    """Tiers by exact score quantile bounds instead of one global sort: a bound is the score of its last rank."""
    from netaccess.operators.ranking import global_rank

    n = scores.agg(F.count("*").alias("n"))
    ranked = global_rank(scores.withColumn("s", F.col("ni") * F.col("cv")), [F.desc("s"), F.asc("edge_id")]).crossJoin(F.broadcast(n))
    tier = F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.01)), 1)
    for k, share in ((2, 0.05), (3, 0.2), (4, 0.5)):
        tier = tier.when(F.col("rank") <= F.floor(F.col("n") * share), k)
    return ranked.groupBy(tier.otherwise(5).alias("tier")).agg(F.count("*").alias("n"))
