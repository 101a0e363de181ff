"""Queries of origin-destination, facility access, isolation and place preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.functions import rules as R
from netaccess.graph.blocks import block_times
from netaccess.graph.components import connected_components
from netaccess.operators import access as A
from netaccess.operators import measures as M
from netaccess.plans.filters import OD_SQL, od_pairs
from netaccess.plans.graphs import CITY, FACILITY_START, place_nodes, three_nets
from netaccess.plans.registry import query
from netaccess.runtime import materialize

PAIR_BLOCKS = 64
SCENARIO_FACTORS = (0.5, 1.0, 2.0)


def two_path_sql(sources: str) -> str:
    """Distances in both weights as d0 and d1, from one recursive statement over (scenario, src)."""
    return f"""WITH RECURSIVE adj AS (SELECT u AS a, v AS b, 0 AS k, w0 AS w FROM edges UNION ALL SELECT v, u, 0, w0 FROM edges UNION ALL SELECT u, v, 1, w1 FROM edges UNION ALL SELECT v, u, 1, w1 FROM edges),
    d(k, src, node, dist) USING KEY (k, src, node) AS (SELECT k, s.* FROM ({sources}) s, (VALUES (0), (1)) x(k) UNION SELECT d.k, d.src, adj.b, min(d.dist + adj.w) FROM d JOIN adj ON d.node = adj.a AND d.k = adj.k
    LEFT JOIN recurring.d AS r ON r.k = d.k AND r.src = d.src AND r.node = adj.b WHERE d.dist + adj.w < coalesce(r.dist, 1e300) GROUP BY d.k, d.src, adj.b)"""


def city_pairs(edges: DataFrame) -> DataFrame:
    """city_a < city_b with t0 and t1 of every pair of places."""
    cities = place_nodes(edges)
    places = cities.withColumn("net", F.lit(0))
    ends = block_times(edges.withColumn("net", F.lit(0)), ["w0", "w1"], places.select("net", F.col("node").alias("src"), "node"), places, later=True)
    found = ends.select(F.col("src").alias("city_a"), F.col("node").alias("city_b"), F.col("w0").alias("t0"), F.col("w1").alias("t1"))
    # all pairs as a join of equal blocks: each city meets those of a block in one task, however many there are
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long")))
    left = cities.select(F.col("node").alias("city_a"), F.pmod(F.xxhash64("node"), F.lit(PAIR_BLOCKS)).alias("block"))
    every = left.join(cities.select(F.col("node").alias("city_b"), blocks.alias("block")), "block").filter("city_a < city_b").drop("block")
    return every.join(found, ["city_a", "city_b"], "left")


def country_city_pairs(edges: DataFrame, least_nodes: int) -> DataFrame:
    """country_id, city_a < city_b, t0, t1: every pair of places in the largest part of each country's own net, ties to the least
    label. Nets of under ``least_nodes`` nodes have no pairs."""
    own = lambda c: F.struct("country_id", F.col(c).alias("id")).alias(c)
    nets = edges.select(own("u"), own("v"), "w0", "w1")
    parts = materialize(connected_components(nets.select("u", "v")), "country-parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.groupBy("component.country_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("best")).filter(F.col("best.n") <= -least_nodes)
    kept = parts.join(best.select("best.component"), "component", "left_semi").select(F.col("node").alias("u"))
    nets = materialize(nets.join(kept, "u", "left_semi"), "country-nets")

    rows = nets.select(F.col("u.country_id").alias("net"), F.col("u.id").alias("u"), F.col("v.id").alias("v"), "w0", "w1")
    places = rows.select("net", F.col("v").alias("node")).distinct()
    ends = block_times(rows, ["w0", "w1"], places.select("net", F.col("node").alias("src"), "node"), places, later=True)
    found = ends.select(F.col("net").alias("country_id"), F.col("src").alias("city_a"), F.col("node").alias("city_b"), F.col("w0").alias("t0"), F.col("w1").alias("t1"))
    cities = nets.select(F.col("v.country_id").alias("country_id"), F.col("v.id").alias("city")).distinct()
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long"))).alias("block")
    left = cities.select("country_id", F.col("city").alias("city_a"), F.pmod(F.xxhash64("city"), F.lit(PAIR_BLOCKS)).alias("block"))
    every = left.join(cities.select("country_id", F.col("city").alias("city_b"), blocks), ["country_id", "block"]).filter("city_a < city_b").drop("block")
    return every.join(found, ["country_id", "city_a", "city_b"], "left")


@query("od1_city_pairs", "edges", sql=two_path_sql(CITY) + " SELECT a.src AS city_a, a.node AS city_b, round(a.dist, 6) AS t0, round(b.dist, 6) AS t1, CASE WHEN (b.dist - a.dist) / a.dist * 100 >= 50 THEN 1 ELSE 0 END AS severe_increase, 'connected' AS conn_type FROM d a JOIN d b ON a.k = 0 AND b.k = 1 AND a.src = b.src AND a.node = b.node WHERE a.src < a.node AND a.node IN (SELECT src FROM d)")
def city_od(edges: DataFrame) -> DataFrame:
    return od_pairs(city_pairs(edges)).select("city_a", "city_b", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "severe_increase", "conn_type")


@query("od3_scenario_od", "edges", sql=f"""WITH RECURSIVE rows AS (SELECT f, u, v, w0 * (1 + (w1 / w0 - 1) * f) AS w FROM edges, (VALUES (0.5::DOUBLE), (1.0), (2.0)) x(f)), adj AS (SELECT f, u AS a, v AS b, w FROM rows UNION ALL SELECT f, v, u, w FROM rows),
    d(f, src, node, dist) USING KEY (f, src, node) AS (SELECT x.f, s.* FROM ({CITY}) s, (VALUES (0.5::DOUBLE), (1.0), (2.0)) x(f) UNION SELECT d.f, d.src, adj.b, min(d.dist + adj.w) FROM d JOIN adj ON d.node = adj.a AND d.f = adj.f
    LEFT JOIN recurring.d AS r ON r.f = d.f AND r.src = d.src AND r.node = adj.b WHERE d.dist + adj.w < coalesce(r.dist, 1e300) GROUP BY d.f, d.src, adj.b)
    SELECT f AS factor, count(*) AS n, round(avg(dist), 6) AS mean FROM d WHERE src < node AND node IN (SELECT v FROM edges) GROUP BY f""")
def scenario_od(edges: DataFrame) -> DataFrame:
    """All pairs of places under three severities of the extreme weights."""
    weights = {f"w_{k}": F.col("w0") * (1 + (F.col("w1") / F.col("w0") - 1) * F.lit(f)) for k, f in enumerate(SCENARIO_FACTORS)}
    rows = edges.select(F.lit(0).alias("net"), "u", "v", *(w.alias(c) for c, w in weights.items()))
    places = place_nodes(edges).withColumn("net", F.lit(0))
    d = block_times(rows, list(weights), places.select("net", F.col("node").alias("src"), "node"), places, later=True)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(c).alias("dist")) for c, f in zip(weights, SCENARIO_FACTORS)))).alias("e")
    return d.select(each).select("e.*").filter("dist IS NOT NULL").groupBy("factor").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("mean"))


@query("od5_gravity_access", "od", "places", sql="SELECT round(sum(CASE WHEN t0 > 0 AND t0 < 1e8 THEN CAST(a.pop_max AS DOUBLE) * b.pop_max / t0 END) / 1e9, 4) AS a_normal, round(sum(CASE WHEN t1 > 0 AND t1 < 1e8 THEN CAST(a.pop_max AS DOUBLE) * b.pop_max / t1 END) / 1e9, 4) AS a_extreme FROM od JOIN places a ON city_a = a.place_id JOIN places b ON city_b = b.place_id")
def gravity_access(od: DataFrame, places: DataFrame) -> DataFrame:
    pop = lambda k: places.select(F.col("place_id").alias(f"city_{k}"), F.col("pop_max").cast("double").alias(f"pop_{k}"))
    rows = od.join(pop("a"), "city_a").join(pop("b"), "city_b")
    term = lambda t: F.sum(F.when((F.col(t) > 0) & (F.col(t) < 1e8), F.col("pop_a") * F.col("pop_b") / F.pow(t, F.lit(C.ACCESS_ALPHA))))
    return rows.agg(F.round(term("t0") / 1e9, 4).alias("a_normal"), F.round(term("t1") / 1e9, 4).alias("a_extreme"))


@query("sk4_wide_matrix", "od", sql="SELECT city_a, " + ", ".join(f"round(min(CASE WHEN city_b = {k} THEN t0 END), 6) AS c{k}" for k in range(2, 11)) + " FROM od WHERE city_b <= 10 GROUP BY city_a")
def wide(od: DataFrame) -> DataFrame:
    cells = od.filter("city_b <= 10").select("city_a", F.concat(F.lit("c"), F.col("city_b").cast("string")).alias("c"), "t0")
    return cells.groupBy("city_a").pivot("c", [f"c{k}" for k in range(2, 11)]).agg(F.round(F.min("t0"), 6))


@query("ac1_facility_access", "edges", "facilities", sql=two_path_sql(FACILITY_START) + " SELECT a.node, round(a.dist, 6) AS t_normal, round(b.dist, 6) AS t_extreme, round(b.dist - a.dist, 6) AS delta_t FROM d a JOIN d b ON a.k = 0 AND b.k = 1 AND a.node = b.node")
def access_times(edges: DataFrame, facilities: DataFrame) -> DataFrame:
    return A.facility_access(edges, facilities).select("node", *(F.round(c, 6).alias(c) for c in ("t_normal", "t_extreme", "delta_t")))


@query("ac2_buffering", "edges", "facilities")
def buffering(edges: DataFrame, facilities: DataFrame) -> DataFrame:
    return A.buffering(edges, facilities).select("node", *(F.round(c, 6).alias(c) for c in ("t_normal", "delta_t", "direct_degradation", "buffering_ratio")))


@query("ac3_amplification_rank", "od", "roads", sql=f"""WITH o AS (SELECT c, avg(increase_pct) AS inc FROM (SELECT country_a AS c, increase_pct FROM ({OD_SQL}) x WHERE conn_type = 'connected' UNION ALL SELECT country_b, increase_pct FROM ({OD_SQL}) y WHERE conn_type = 'connected') e GROUP BY c),
    r AS (SELECT country_id, avg((v_normal - v_extreme) / v_normal * 100) AS d FROM roads GROUP BY country_id), j AS (SELECT country_id, round(inc / nullif(d, 0), 5) AS amplification FROM o JOIN r ON c = country_id)
    SELECT country_id, amplification, row_number() OVER (ORDER BY amplification DESC, country_id) AS rank FROM j""")
def amplification_rank(od: DataFrame, roads: DataFrame) -> DataFrame:
    from netaccess.operators.ranking import global_rank

    ends = od_pairs(od).filter("conn_type = 'connected'").select(F.explode(F.array("country_a", "country_b")).alias("country_id"), "increase_pct")
    drop = roads.groupBy("country_id").agg(F.avg(R.speed_drop_pct(F.col("v_normal"), F.col("v_extreme"))).alias("d"))
    j = ends.groupBy("country_id").agg(F.avg("increase_pct").alias("inc")).join(drop, "country_id").select("country_id", F.round(F.try_divide("inc", "d"), 5).alias("amplification"))
    return global_rank(j, [F.desc("amplification"), F.asc("country_id")])


NEAR = "SELECT city, count(*) FILTER (WHERE t0 > 0 AND t0 < 0.5) AS n0, count(*) FILTER (WHERE t1 > 0 AND t1 < 0.5) AS n1 FROM (SELECT city_a AS city, t0, t1 FROM od UNION ALL SELECT city_b, t0, t1 FROM od) e GROUP BY city"


@query("ac4_neighbour_counts", "od", sql=f"SELECT city, n0, n1, n0 - n1 AS lost FROM ({NEAR}) t")
def neighbours(od: DataFrame) -> DataFrame:
    ends = od.select(F.explode(F.array("city_a", "city_b")).alias("city"), "t0", "t1")
    inside = lambda t: F.count_if((F.col(t) > 0) & (F.col(t) < 0.5))
    return ends.groupBy("city").agg(inside("t0").alias("n0"), inside("t1").alias("n1")).withColumn("lost", F.col("n0") - F.col("n1"))


@query("ac5_deisolated_pairs", "od", sql="SELECT country_a, count(*) AS n, count(*) FILTER (WHERE t1 / t0 - 1 > 0.5) AS isolated, count(*) FILTER (WHERE t1 / t0 - 1 > 0.5 AND (t0 + (t1 - t0) / 2) / t0 - 1 <= 0.5) AS de_isolated FROM od WHERE t0 IS NOT NULL AND t1 IS NOT NULL GROUP BY country_a")
def deisolated(od: DataFrame) -> DataFrame:
    """Pairs slowed beyond the threshold that half of the delay would bring back under it."""
    slow = F.col("t1") / F.col("t0") - 1 > 0.5
    after = (F.col("t0") + (F.col("t1") - F.col("t0")) / 2) / F.col("t0") - 1
    return od.filter("t0 IS NOT NULL AND t1 IS NOT NULL").groupBy("country_a").agg(F.count("*").alias("n"), F.count_if(slow).alias("isolated"), F.count_if(slow & (after <= 0.5)).alias("de_isolated"))


AUDIT = "SELECT {r} AS radius, count(*) AS n_facilities, count(d2) AS n_snapped, round(avg(sqrt(d2)), 5) AS mean_dist FROM facilities f LEFT JOIN (SELECT f.facility_id, min((f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y)) AS d2 FROM facilities f JOIN pixels p ON (f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y) <= {r} * {r} GROUP BY f.facility_id) n ON f.facility_id = n.facility_id"


@query("ac6_snap_audit", "facilities", "pixels", sql=" UNION ALL ".join(AUDIT.format(r=r) for r in (5, 10, 20)))
def snap_audit(facilities: DataFrame, pixels: DataFrame) -> DataFrame:
    """One search at the widest radius answers the narrower ones."""
    from netaccess.operators.spatial import nearest

    near = nearest(facilities, "facility_id", pixels, "pixel_id", "x", "y", 20.0, 10.0)
    rows = facilities.select("facility_id").join(near, "facility_id", "left").withColumn("radius", F.explode(F.array(*map(F.lit, (5, 10, 20)))))
    d = F.when(F.col("d2") <= F.col("radius") * F.col("radius"), F.sqrt("d2"))
    return rows.groupBy("radius").agg(F.count("*").alias("n_facilities"), F.count(d).alias("n_snapped"), F.round(F.avg(d), 5).alias("mean_dist"))


@query("ac8_variant_metrics", "access", sql="SELECT s.scale, t.h AS hours, round(sum(CASE WHEN t_normal * s.scale <= t.h THEN population ELSE 0 END) / sum(population) * 100, 5) AS coverage FROM access, (VALUES (0.8::DOUBLE), (1.0), (1.2)) s(scale), (VALUES (0.5::DOUBLE), (1.0), (2.0)) t(h) GROUP BY s.scale, t.h")
def variants(access: DataFrame) -> DataFrame:
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(h).alias("hours")) for s in (0.8, 1.0, 1.2) for h in (0.5, 1.0, 2.0))))
    rows = access.select("t_normal", "population", grid.alias("g")).select("t_normal", "population", "g.*")
    inside = F.coalesce(F.col("t_normal") * F.col("scale") <= F.col("hours"), F.lit(False))
    return rows.groupBy("scale", "hours").agg(F.round(F.sum(F.when(inside, F.col("population")).otherwise(0.0)) / F.sum("population") * 100, 5).alias("coverage"))


@query("pl1_capitals", "places", sql="SELECT country_id, arg_max(place_id, pop_max * 1000000 - place_id) AS place_id FROM places WHERE featurecla = 'Admin-0 capital' GROUP BY country_id")
def capitals(places: DataFrame) -> DataFrame:
    return places.filter("featurecla = 'Admin-0 capital'").groupBy("country_id").agg(F.max_by("place_id", F.struct("pop_max", -F.col("place_id"))).alias("place_id"))


@query("pl2_megacities", "places", sql="SELECT place_id, pop_max FROM places WHERE megacity = 1 AND featurecla <> 'Admin-0 capital' AND pop_max > 1000 ORDER BY pop_max DESC, place_id")
def megacities(places: DataFrame) -> DataFrame:
    caps = places.filter("featurecla = 'Admin-0 capital'").select("place_id")
    return places.filter("megacity = 1 AND pop_max > 1000").join(caps, "place_id", "left_anti").select("place_id", "pop_max")


@query("pl3_continent_nodes", "places", sql="SELECT place_id, 'capital' AS type FROM places WHERE featurecla = 'Admin-0 capital' UNION ALL SELECT place_id, 'megacity' FROM places WHERE megacity = 1 AND featurecla <> 'Admin-0 capital'")
def continent_nodes(places: DataFrame) -> DataFrame:
    caps = places.filter("featurecla = 'Admin-0 capital'").select("place_id", F.lit("capital").alias("type"))
    mega = places.filter("megacity = 1").join(caps, "place_id", "left_anti").select("place_id", F.lit("megacity").alias("type"))
    return caps.unionByName(mega)


@query("pl4_city_nodes", "places", sql="""SELECT country_id, level, arg_max(place_id, pop_max * 1000000 - place_id) AS place_id, count(*) AS n FROM (SELECT *, CASE WHEN featurecla LIKE 'Admin-0%' THEN 'capital' WHEN featurecla LIKE 'Admin-1%' THEN 'regional' WHEN pop_max >= 300000 THEN 'city' END AS level FROM places) t WHERE level IS NOT NULL GROUP BY country_id, level""")
def city_nodes(places: DataFrame) -> DataFrame:
    rows = places.withColumn("level", R.place_level(F.col("featurecla"), F.col("pop_max"), 300_000)).filter("level IS NOT NULL")
    return rows.groupBy("country_id", "level").agg(F.max_by("place_id", F.struct("pop_max", -F.col("place_id"))).alias("place_id"), F.count("*").alias("n"))


@query("sk2_group_minimum", "roads", sql="SELECT country_id, u % 25 AS district, count(*) AS n FROM roads GROUP BY 1, 2 HAVING count(*) >= 5")
def group_minimum(roads: DataFrame) -> DataFrame:
    """Groups large enough to be written as partitions of their own."""
    return roads.groupBy("country_id", (F.col("u") % 25).alias("district")).agg(F.count("*").alias("n")).filter("n >= 5")


@query("ag16_group_buffering", "access", sql="""WITH s AS (SELECT *, sum(population) OVER (PARTITION BY country_id ORDER BY t_normal, node_id) / sum(population) OVER (PARTITION BY country_id) AS share FROM access WHERE t_normal IS NOT NULL AND population > 0 AND t_extreme IS NOT NULL)
    SELECT country_id, round(sum(CASE WHEN round(share, 9) BETWEEN 0.4 AND 0.6 THEN (t_extreme - t_normal) * population END) / nullif(sum(CASE WHEN round(share, 9) BETWEEN 0.4 AND 0.6 THEN population END), 0), 5) AS p50, round(sum(CASE WHEN round(share, 9) > 0.8 THEN (t_extreme - t_normal) * population END) / nullif(sum(CASE WHEN round(share, 9) > 0.8 THEN population END), 0), 5) AS p90 FROM s GROUP BY country_id""")
def group_buffering(access: DataFrame) -> DataFrame:
    rows = access.filter("t_normal IS NOT NULL AND population > 0 AND t_extreme IS NOT NULL")
    upto = F.sum("population").over(Window.partitionBy("country_id").orderBy("t_normal", "node_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("share", F.round(upto / F.sum("population").over(Window.partitionBy("country_id")), 9)).withColumn("d", F.col("t_extreme") - F.col("t_normal"))
    mean = lambda inside: F.round(F.try_divide(F.sum(F.when(inside, F.col("d") * F.col("population"))), F.sum(F.when(inside, F.col("population")))), 5)
    return rows.groupBy("country_id").agg(mean(F.col("share").between(0.4, 0.6)).alias("p50"), mean(F.col("share") > 0.8).alias("p90"))


@query("od2_continent_summary", "od", "country", sql=f"""SELECT region, count(*) AS n, count(*) FILTER (WHERE conn_type = 'connected') AS n_connected, round(CAST(count(*) FILTER (WHERE conn_type = 'climate_disconnected') AS DOUBLE) / count(*), 6) AS climate_ratio,
    round(CAST(count(*) FILTER (WHERE conn_type = 'both_unreachable') AS DOUBLE) / count(*), 6) AS both_ratio, round(avg(increase_pct), 5) AS mean, round(median(increase_pct), 5) AS med, round(quantile_cont(increase_pct, 0.75), 5) AS q75, round(CAST(sum(severe_increase) AS DOUBLE) / count(*), 6) AS severe_share
    FROM ({OD_SQL}) t JOIN country c ON t.country_a = c.country_id GROUP BY region""")
def continent_summary(od: DataFrame, country: DataFrame) -> DataFrame:
    return M.od_summary(od_pairs(od).join(country, F.col("country_a") == F.col("country_id")), ["region"])


@query("od4_scaled_metrics", "od", sql=f"SELECT f AS factor, count(*) AS n, round(avg((t0 * (1 + (t1 / t0 - 1) * f) - t0) / t0 * 100), 5) AS mean_increase, count(*) FILTER (WHERE (t1 / t0 - 1) * f * 100 >= 50) AS n_severe FROM od, (VALUES (0.5::DOUBLE), (1.0), (1.5)) x(f) WHERE t0 > 0 AND t1 IS NOT NULL GROUP BY f")
def scaled_metrics(od: DataFrame) -> DataFrame:
    """All severities in one pass over the pairs."""
    slow = (F.col("t1") / F.col("t0") - 1) * F.col("factor")
    rows = od.filter("t0 > 0 AND t1 IS NOT NULL").withColumn("factor", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5)))))
    return rows.groupBy("factor").agg(F.count("*").alias("n"), F.round(F.avg((F.col("t0") * (1 + slow) - F.col("t0")) / F.col("t0") * 100), 5).alias("mean_increase"), F.count_if(slow * 100 >= 50).alias("n_severe"))


@query("od6_district_metrics", "edges")
def district_metrics(edges: DataFrame) -> DataFrame:
    """Size, parts, efficiency, diameter, bridges, road drop and amplification of every country as a district, all in one graph."""
    from netaccess.graph.structure import bridges, network_metrics

    d = edges.select(F.col("country_id").alias("district"), "u", "v", "w0", "w1", "p_block")
    metrics = network_metrics(three_nets(d, "district").filter("net.kind < 2"))
    of = lambda c, k: F.max(F.when(F.col("net.kind") == k, F.col(c)))
    wide = metrics.groupBy(F.col("net.district").alias("district")).agg(
        of("n_nodes", 0).alias("n_nodes"), of("lcc_ratio", 0).alias("lcc_ratio"), *(of(c, k).alias(f"{n}{k}") for c, n in (("efficiency", "e"), ("diameter", "d"), ("n_components", "c")) for k in (0, 1))
    )
    node = lambda c: F.struct("district", F.col(c).alias("id"))
    cut = bridges(d.select(node("u").alias("u"), node("v").alias("v"))).groupBy(F.col("u.district").alias("district")).agg(F.count("*").alias("n_bridges"))
    roads = d.groupBy("district").agg(F.count("*").alias("n_edges"), F.avg((1 - F.col("w0") / F.col("w1")) * 100).alias("road_drop"), F.avg("p_block").alias("p_block"))
    out = wide.join(roads, "district").join(cut, "district", "left")
    loss = F.when(F.col("e0") > 0, (F.col("e0") - F.col("e1")) / F.col("e0") * 100)
    return out.select(
        "district", "n_nodes", "n_edges", F.round("lcc_ratio", 6).alias("lcc_ratio"), F.round(F.coalesce("n_bridges", F.lit(0)) / F.col("n_edges"), 6).alias("bridge_ratio"), F.round("road_drop", 5).alias("mean_road_degradation_pct"),
        F.round("p_block", 6).alias("mean_p_block"), *(F.round(c, 6).alias(k) for c, k in (("e0", "e_normal"), ("e1", "e_extreme"), ("d0", "d_normal"), ("d1", "d_extreme"))), F.round(loss, 5).alias("efficiency_loss_pct"),
        F.col("c0").alias("n_comp_normal"), F.col("c1").alias("n_comp_extreme"), (F.col("c1") - F.col("c0")).alias("delta_components"), F.round(F.when(F.col("road_drop") > 0, loss / F.col("road_drop")), 5).alias("amplification"),
    )


@query("ac7_population_snap_audit", "pixels", "places", sql=" UNION ALL ".join(f"SELECT {r} AS radius, round(sum(pop), 2) AS total, round(sum(CASE WHEN d2 <= {r * r} THEN pop ELSE 0 END) / sum(pop) * 100, 5) AS snapped_pct FROM pixels p LEFT JOIN (SELECT a.pixel_id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM pixels a JOIN places b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600 GROUP BY a.pixel_id) n ON p.pixel_id = n.pixel_id" for r in (15, 30, 60)))
def population_snap(pixels: DataFrame, places: DataFrame) -> DataFrame:
    from netaccess.operators.spatial import nearest

    near = nearest(pixels, "pixel_id", places, "place_id", "x", "y", 60.0, 30.0)
    rows = pixels.select("pixel_id", "pop").join(near, "pixel_id", "left").withColumn("radius", F.explode(F.array(*map(F.lit, (15, 30, 60)))))
    inside = F.sum(F.when(F.col("d2") <= F.col("radius") * F.col("radius"), F.col("pop")).otherwise(0.0))
    return rows.groupBy("radius").agg(F.round(F.sum("pop"), 2).alias("total"), F.round(inside / F.sum("pop") * 100, 5).alias("snapped_pct"))


@query("pl5_district_layer", "roads", "pixels", "region", sql="""WITH g AS (SELECT CAST(r_regionkey AS BIGINT) AS r_id FROM region), h AS (SELECT p.pixel_id, p.x, p.y, min(CASE WHEN x >= 10 * r_id AND x < 10 * r_id + 200 AND y >= 150 * r_id AND y < 150 * r_id + 300 THEN r_id END) AS d FROM pixels p, g GROUP BY p.pixel_id, p.x, p.y),
    c AS (SELECT r_id, 10 * r_id + 100 AS cx, 150 * r_id + 150 AS cy FROM g) SELECT coalesce(d, (SELECT arg_min(r_id, ((x - cx) * (x - cx) + (y - cy) * (y - cy)) * 10 + r_id) FROM c)) AS district, count(*) AS n FROM h GROUP BY 1""")
def district_layer(roads: DataFrame, pixels: DataFrame, region: DataFrame) -> DataFrame:
    """Points in the first polygon that holds them, else in that of the nearest centroid; polygons are a handful."""
    from netaccess.operators.spatial import first_polygon

    k = F.col("r_regionkey").cast("bigint")
    corner = lambda dx, dy: F.struct((10 * k + dx - 0.5).alias("x"), (150 * k + dy - 0.5).alias("y"))
    shapes = region.select(k.alias("polygon_id"), F.array(corner(0, 0), corner(200, 0), corner(200, 300), corner(0, 300), corner(0, 0)).alias("ring"))
    points = pixels.select("pixel_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = first_polygon(points, shapes, "x", "y", 100.0)
    centres = F.broadcast(region.agg(F.collect_list(F.struct((10 * k + 100).alias("cx"), (150 * k + 150).alias("cy"), k.alias("id"))).alias("centres")))
    gap = lambda c: F.pow(F.col("x") - c["cx"], F.lit(2)) + F.pow(F.col("y") - c["cy"], F.lit(2))
    closest = F.array_min(F.transform("centres", lambda c: F.struct(gap(c).alias("d"), c["id"].alias("id"))))["id"]
    return found.crossJoin(centres).groupBy(F.coalesce("polygon_id", closest).alias("district")).agg(F.count("*").alias("n"))
