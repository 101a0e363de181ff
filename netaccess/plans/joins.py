"""Queries of joins: lookups with defaults, validated merges, pair attribution and interval overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.operators import joining as J
from netaccess.plans.filters import OD_SQL, od_pairs
from netaccess.plans.registry import query


@query("jn1_roads_speeds", "edges", "roads", sql="SELECT e.road_id, e.u, e.v, r.v_normal, r.v_extreme FROM edges e LEFT JOIN (SELECT * FROM roads WHERE length_km > 10) r ON e.road_id = r.road_id")
def roads_speeds(edges: DataFrame, roads: DataFrame) -> DataFrame:
    speeds = roads.filter("length_km > 10").select("road_id", "v_normal", "v_extreme")
    return edges.select("road_id", "u", "v").join(speeds, "road_id", "left")


@query("jn2_speed_default", "edges", "roads", sql="""WITH s AS (SELECT road_id, v_normal, v_extreme, 1 - pass_extreme AS p FROM roads WHERE length_km > 10), m AS (SELECT country_id, median(v_normal) AS med FROM roads GROUP BY country_id)
    SELECT e.road_id, coalesce(s.v_normal, m.med) AS v0, coalesce(s.v_extreme, m.med) AS v1, coalesce(s.p, 0.0) AS p FROM edges e LEFT JOIN s ON e.road_id = s.road_id JOIN m ON e.country_id = m.country_id""")
def speed_default(edges: DataFrame, roads: DataFrame) -> DataFrame:
    speeds = roads.filter("length_km > 10").select("road_id", F.col("v_normal").alias("v0"), F.col("v_extreme").alias("v1"), (1 - F.col("pass_extreme")).alias("p"))
    fallback = roads.groupBy("country_id").agg(F.median("v_normal").alias("med"))
    joined = edges.select("road_id", "country_id").join(speeds, "road_id", "left").join(fallback, "country_id")
    return joined.select("road_id", F.coalesce("v0", "med").alias("v0"), F.coalesce("v1", "med").alias("v1"), F.coalesce("p", F.lit(0.0)).alias("p"))


@query("jn3_column_defaults", "edges", "roads", sql="SELECT e.road_id, s.v_normal, coalesce(s.pass_extreme, 0.65) AS pass_extreme, coalesce(s.length_km, 0.0) AS length_km FROM edges e LEFT JOIN (SELECT * FROM roads WHERE surface IS NOT NULL) s ON e.road_id = s.road_id")
def column_defaults(edges: DataFrame, roads: DataFrame) -> DataFrame:
    known = roads.filter("surface IS NOT NULL").select("road_id", "v_normal", "pass_extreme", "length_km")
    return J.left_with_defaults(edges.select("road_id"), known, ["road_id"], {"pass_extreme": 0.65, "length_km": 0.0})


ROAD_BY = "SELECT country_id, count(*) AS n_roads, avg((v_normal - v_extreme) / v_normal * 100) AS drop_pct FROM roads WHERE v_normal > 0 GROUP BY country_id"


@query("jn4_od_road_amplification", "od", "roads", sql=f"""WITH p AS ({OD_SQL}), o AS (SELECT country_a AS country_id, count(*) AS n_pairs, avg(increase_pct) AS inc FROM p WHERE conn_type = 'connected' GROUP BY country_a), r AS ({ROAD_BY})
    SELECT o.country_id, n_pairs, n_roads, round(inc / nullif(drop_pct, 0), 5) AS amplification FROM o JOIN r ON o.country_id = r.country_id""")
def amplification(od: DataFrame, roads: DataFrame) -> DataFrame:
    pairs = od_pairs(od).filter("conn_type = 'connected'").groupBy(F.col("country_a").alias("country_id")).agg(F.count("*").alias("n_pairs"), F.avg("increase_pct").alias("inc"))
    drop = (F.col("v_normal") - F.col("v_extreme")) / F.col("v_normal") * 100
    road = roads.filter("v_normal > 0").groupBy("country_id").agg(F.count("*").alias("n_roads"), F.avg(drop).alias("drop_pct"))
    return pairs.join(road, "country_id").select("country_id", "n_pairs", "n_roads", F.round(F.try_divide("inc", "drop_pct"), 5).alias("amplification"))


@query("jn5_pair_attribution", "od", sql=f"""SELECT country_id, count(*) AS n, round(avg(increase_pct), 5) AS mean_increase FROM (SELECT country_a AS country_id, increase_pct FROM ({OD_SQL}) a WHERE conn_type = 'connected'
    UNION ALL SELECT country_b, increase_pct FROM ({OD_SQL}) b WHERE conn_type = 'connected') t GROUP BY country_id""")
def attribution(od: DataFrame) -> DataFrame:
    """A pair inside one country counts twice for it."""
    ends = od_pairs(od).filter("conn_type = 'connected'").select(F.explode(F.array("country_a", "country_b")).alias("country_id"), "increase_pct")
    return ends.groupBy("country_id").agg(F.count("*").alias("n"), F.round(F.avg("increase_pct"), 5).alias("mean_increase"))


@query("jn6_access_indicators", "access", "country", sql="SELECT c.country, count(*) AS n, round(avg(t_normal), 6) AS t FROM access a JOIN country c ON a.country_id = c.country_id GROUP BY c.country")
def indicators(access: DataFrame, country: DataFrame) -> DataFrame:
    return access.join(country, "country_id").groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("t_normal"), 6).alias("t"))


@query("jn7_population_combine", "country", "places", "pixels", sql="""WITH a AS (SELECT country_id, CAST(sum(pop_max) AS DOUBLE) AS pop FROM places GROUP BY country_id HAVING country_id % 3 <> 0), b AS (SELECT country_id, sum(pop) AS pop FROM pixels GROUP BY country_id)
    SELECT c.country, round(nullif(coalesce(a.pop, b.pop), 0), 4) AS population FROM country c LEFT JOIN a ON c.country_id = a.country_id LEFT JOIN b ON c.country_id = b.country_id""")
def population_combine(country: DataFrame, places: DataFrame, pixels: DataFrame) -> DataFrame:
    first = places.filter("country_id % 3 <> 0").groupBy("country_id").agg(F.sum("pop_max").cast("double").alias("a"))
    second = pixels.groupBy("country_id").agg(F.sum("pop").alias("b"))
    joined = country.join(first, "country_id", "left").join(second, "country_id", "left")
    return joined.select("country", F.round(F.nullif(F.coalesce("a", "b"), F.lit(0.0)), 4).alias("population"))


CELL = "CAST(floor(lon / 2) AS BIGINT) AS cx, CAST(floor(lat / 2) AS BIGINT) AS cy"


@query("jn8_grid_facilities", "access", "facilities", sql=f"""WITH g AS (SELECT cx, cy, count(*) AS n_nodes FROM (SELECT {CELL} FROM access) t GROUP BY cx, cy), f AS (SELECT cx, cy, count(*) AS n FROM (SELECT {CELL} FROM facilities) t GROUP BY cx, cy)
    SELECT g.cx, g.cy, n_nodes, coalesce(f.n, 0) AS n_facilities FROM g LEFT JOIN f ON g.cx = f.cx AND g.cy = f.cy""")
def grid_facilities(access: DataFrame, facilities: DataFrame) -> DataFrame:
    grid = J.cells(access, 2.0).groupBy("cx", "cy").agg(F.count("*").alias("n_nodes"))
    found = J.cells(facilities, 2.0).groupBy("cx", "cy").agg(F.count("*").alias("n_facilities"))
    return J.left_with_defaults(grid, found, ["cx", "cy"], {"n_facilities": 0})


@query("jn9_grid_variants", "access", "facilities", sql=f"""WITH g AS (SELECT DISTINCT {CELL} FROM access), f AS (SELECT coalesce(amenity, 'none') AS variant, {CELL} FROM facilities), k AS (SELECT DISTINCT variant FROM f)
    SELECT k.variant, g.cx, g.cy, count(f.cx) AS n FROM k CROSS JOIN g LEFT JOIN f ON f.variant = k.variant AND f.cx = g.cx AND f.cy = g.cy GROUP BY k.variant, g.cx, g.cy""")
def grid_variants(access: DataFrame, facilities: DataFrame) -> DataFrame:
    grid = J.cells(access, 2.0).select("cx", "cy").distinct()
    found = J.cells(facilities, 2.0).select(F.coalesce("amenity", F.lit("none")).alias("variant"), "cx", "cy")
    counts = found.groupBy("variant", "cx", "cy").agg(F.count("*").alias("n"))
    frame = grid.crossJoin(F.broadcast(found.select("variant").distinct()))
    return J.left_with_defaults(frame, counts, ["variant", "cx", "cy"], {"n": 0})


@query("jn10_variant_vs_default", "access", sql="""WITH v AS (SELECT country_id, CASE WHEN node_id % 3 = 0 THEN 'default' WHEN node_id % 3 = 1 THEN 'a' ELSE 'b' END AS variant, avg(t_normal) AS t FROM access GROUP BY 1, 2)
    SELECT x.country_id, x.variant, round(x.t - y.t, 6) AS diff FROM v x LEFT JOIN v y ON x.country_id = y.country_id AND y.variant = 'default'""")
def variant_vs_default(access: DataFrame) -> DataFrame:
    variant = F.when(F.col("node_id") % 3 == 0, "default").when(F.col("node_id") % 3 == 1, "a").otherwise("b")
    means = access.groupBy("country_id", variant.alias("variant")).agg(F.avg("t_normal").alias("t"))
    return J.against_default(means, "variant", "default", ["country_id"], "t").select("country_id", "variant", F.round("diff", 6).alias("diff"))


@query("jn11_three_way", "access", "places", "facilities", sql="""WITH a AS (SELECT country_id, avg(t_normal) AS t FROM access GROUP BY country_id), p AS (SELECT country_id, count(*) AS n_places FROM places GROUP BY country_id), f AS (SELECT country_id, count(*) AS n_facilities FROM facilities GROUP BY country_id)
    SELECT a.country_id, round(a.t, 6) AS t, n_places, n_facilities FROM a LEFT JOIN p ON a.country_id = p.country_id LEFT JOIN f ON a.country_id = f.country_id""")
def three_way(access: DataFrame, places: DataFrame, facilities: DataFrame) -> DataFrame:
    t = access.groupBy("country_id").agg(F.round(F.avg("t_normal"), 6).alias("t"))
    p = places.groupBy("country_id").agg(F.count("*").alias("n_places"))
    f = facilities.groupBy("country_id").agg(F.count("*").alias("n_facilities"))
    return t.join(p, "country_id", "left").join(f, "country_id", "left")


@query("jn14_validated_inner", "country", "places", sql="SELECT c.country, n FROM country c JOIN (SELECT country_id, count(*) AS n FROM places GROUP BY country_id) p ON c.country_id = p.country_id")
def validated(country: DataFrame, places: DataFrame) -> DataFrame:
    counts = places.groupBy("country_id").agg(F.count("*").alias("n"))
    return J.one_to_one(country.select("country_id", "country"), counts, ["country_id"]).select("country", "n")


@query("jn15_outer_indicator", "places", "facilities", sql="""WITH a AS (SELECT DISTINCT country_id FROM places WHERE pop_max > 600000), b AS (SELECT DISTINCT country_id FROM facilities)
    SELECT coalesce(a.country_id, b.country_id) AS country_id, CASE WHEN b.country_id IS NULL THEN 'left_only' WHEN a.country_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.country_id = b.country_id""")
def outer_indicator(places: DataFrame, facilities: DataFrame) -> DataFrame:
    a = places.filter("pop_max > 600000").select("country_id").distinct()
    return J.with_indicator(a, facilities.select("country_id").distinct(), ["country_id"])


@query("jn16_pair_key", "od", sql=f"""WITH p AS ({OD_SQL}) SELECT a.city_a, a.city_b, round(a.t0, 6) AS t0_x, round(b.t1, 6) AS t1_y FROM (SELECT * FROM p WHERE conn_type = 'connected') a JOIN (SELECT * FROM p WHERE severe_increase = 1) b ON a.city_a = b.city_a AND a.city_b = b.city_b""")
def pair_key(od: DataFrame) -> DataFrame:
    p = od_pairs(od)
    x = p.filter("conn_type = 'connected'").select("city_a", "city_b", F.round("t0", 6).alias("t0_x"))
    return x.join(p.filter("severe_increase = 1").select("city_a", "city_b", F.round("t1", 6).alias("t1_y")), ["city_a", "city_b"])


@query("jn18_semi_nodes", "edges_s", sql="""WITH d AS (SELECT n FROM (SELECT u AS n FROM edges_s UNION ALL SELECT v FROM edges_s) t GROUP BY n HAVING count(*) >= 2) SELECT u, v FROM edges_s WHERE u IN (SELECT n FROM d) AND v IN (SELECT n FROM d)""")
def semi_nodes(edges: DataFrame) -> DataFrame:
    busy = edges.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").count().filter("count >= 2").select("n")
    return edges.select("u", "v").join(busy.withColumnRenamed("n", "u"), "u", "left_semi").join(busy.withColumnRenamed("n", "v"), "v", "left_semi")


@query("jn19_anti_names", "places", sql="SELECT place_id, name FROM places WHERE megacity = 1 AND name NOT IN (SELECT name FROM places WHERE featurecla = 'Admin-0 capital')")
def anti_names(places: DataFrame) -> DataFrame:
    return places.filter("megacity = 1").join(places.filter("featurecla = 'Admin-0 capital'").select("name"), "name", "left_anti").select("place_id", "name")


@query("jn20_country_pairs", "country", sql="SELECT a.country_id AS i, b.country_id AS j FROM country a JOIN country b ON a.country_id < b.country_id AND a.region_id = b.region_id")
def country_pairs(country: DataFrame) -> DataFrame:
    """Unordered pairs within a region: an equi-join on the region keeps the pairs bounded by it."""
    a = country.select("region_id", F.col("country_id").alias("i"))
    return a.join(country.select("region_id", F.col("country_id").alias("j")), "region_id").filter("i < j").select("i", "j")


@query("jn21_scenarios", "country", sql="SELECT country_id, s AS share, a AS alpha FROM country, (VALUES (0.01::DOUBLE), (0.03), (0.05), (0.1)) x(s), (VALUES (1.5::DOUBLE), (2.0), (2.5)) y(a)")
def scenarios(country: DataFrame) -> DataFrame:
    from netaccess import config as C

    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.lit(a).alias("alpha")) for s in C.SHARES for a in C.SCORE_ALPHAS)))
    return country.select("country_id", grid.alias("g")).select("country_id", "g.share", "g.alpha")


@query("jn22_name_match", "places", "customer", sql="""SELECT place_id, custkey FROM (SELECT p.place_id, c.c_custkey AS custkey, row_number() OVER (PARTITION BY p.place_id ORDER BY c.c_acctbal DESC, c.c_custkey) AS r
    FROM places p JOIN customer c ON p.country_id = c.c_nationkey AND replace(lower(p.name), 'supplier#', '') = replace(lower(c.c_name), 'customer#', '')) t WHERE r = 1""")
def name_match(places: DataFrame, customer: DataFrame) -> DataFrame:
    norm = lambda c, word: F.replace(F.lower(c), F.lit(word), F.lit(""))
    left = places.select("place_id", "country_id", norm("name", "supplier#").alias("key"))
    right = customer.select(F.col("c_nationkey").cast("bigint").alias("country_id"), norm("c_name", "customer#").alias("key"), "c_custkey", "c_acctbal")
    best = F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey")))
    return left.join(right, ["country_id", "key"]).groupBy("place_id").agg(best.alias("custkey"))


CITY_NAMES = "SELECT place_id, country_id AS iso, concat('Città-', CAST(place_id % 60 AS STRING)) AS name FROM places"
POINT_NAMES = """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS iso, concat(CASE c_custkey % 3 WHEN 0 THEN 'CITTÀ  ' WHEN 1 THEN 'Ville ' ELSE concat(chr(39), 'Cittá ') END, CAST(c_custkey % 50 AS STRING)) AS name,
    CASE WHEN c_custkey % 4 = 0 THEN concat('citta ', CAST(c_custkey % 50 AS STRING)) END AS ascii_name, greatest(c_acctbal, 0) AS pop_max, c_custkey % 2 AS megacity, c_custkey % 5 AS worldcity, c_mktsegment AS feature, CAST((c_custkey * 53) % 997 AS DOUBLE) / 50 AS lon, CAST((c_custkey * 71) % 991 AS DOUBLE) / 50 AS lat FROM customer"""
OVERRIDES = {"Città-55": (1.5, 2.5), "Città-7": (3.0, 4.0)}


def folded_sql(c: str) -> str:
    return rf"trim(regexp_replace(replace(replace(lower(regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g')), chr(39), ''), '-', ' '), '\s+', ' ', 'g'))"


@query("jn22_ranked_names", "places", "customer", sql=f"""WITH l AS ({CITY_NAMES.replace('AS STRING', 'AS VARCHAR')}), r AS ({POINT_NAMES.replace('AS STRING', 'AS VARCHAR')}), n AS (SELECT *, {folded_sql("name")} AS a, {folded_sql("coalesce(ascii_name, '')")} AS b FROM r),
    m AS (SELECT l.place_id, n.id, n.lon, n.lat, row_number() OVER (PARTITION BY l.place_id ORDER BY pop_max DESC, megacity DESC, worldcity DESC, feature, n.id) AS r FROM l JOIN n ON l.iso = n.iso AND {folded_sql("l.name")} IN (a, b)),
    o AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in OVERRIDES.items())}) v(name, lon, lat))
    SELECT l.place_id, CASE WHEN m.id IS NOT NULL THEN 'name' WHEN o.name IS NOT NULL THEN 'override' ELSE 'missing' END AS matched_by, m.id, coalesce(m.lon, o.lon) AS lon, coalesce(m.lat, o.lat) AS lat FROM l LEFT JOIN m ON l.place_id = m.place_id AND m.r = 1 LEFT JOIN o ON l.name = o.name""")
def ranked_names(places: DataFrame, customer: DataFrame) -> DataFrame:
    """Names without marks in either of two columns, the best of several by four keys, an override map, and what stays missing."""
    spark = places.sparkSession
    left, right = spark.sql(CITY_NAMES.replace("FROM places", "FROM {places}"), places=places), spark.sql(POINT_NAMES.replace("FROM customer", "FROM {customer}"), customer=customer)
    # the feature counts upwards: its letters, turned, make a descending key
    best = [F.col("pop_max"), F.col("megacity"), F.col("worldcity"), F.transform(F.split("feature", ""), lambda c: -F.ascii(c))]
    return J.name_matches(left, right, "place_id", best, OVERRIDES)


@query("jn23_two_coordinates", "od", "places", sql="SELECT city_a, city_b, p.lon AS lon_a, p.lat AS lat_a, q.lon AS lon_b, q.lat AS lat_b FROM od JOIN places p ON city_a = p.place_id JOIN places q ON city_b = q.place_id")
def two_coordinates(od: DataFrame, places: DataFrame) -> DataFrame:
    at = lambda k: places.select(F.col("place_id").alias(f"city_{k}"), F.col("lon").alias(f"lon_{k}"), F.col("lat").alias(f"lat_{k}"))
    return od.select("city_a", "city_b").join(at("a"), "city_a").join(at("b"), "city_b")


@query("jn25_interval_overlap", "events", sql="""WITH w AS (SELECT user_id, event_type, CAST(extract(hour FROM min(ts)) AS BIGINT) + 24 * CAST(extract(day FROM min(ts)) AS BIGINT) AS lo, CAST(extract(hour FROM max(ts)) AS BIGINT) + 24 * CAST(extract(day FROM max(ts)) AS BIGINT) AS hi FROM events GROUP BY user_id, event_type, extract(day FROM ts))
    SELECT count(*) AS n, CAST(sum(a.lo + b.hi) AS BIGINT) AS s FROM w a JOIN w b ON a.lo <= b.hi AND a.hi >= b.lo AND a.user_id < b.user_id AND a.event_type = b.event_type""")
def interval_overlap(events: DataFrame) -> DataFrame:
    hour = lambda c: (F.hour(c) + 24 * F.dayofmonth(c)).cast("bigint")
    w = events.groupBy("user_id", "event_type", F.dayofmonth("ts").alias("d")).agg(hour(F.min("ts")).alias("lo"), hour(F.max("ts")).alias("hi")).drop("d")
    pairs = J.overlapping(w, w, "lo", "hi", width=24, on=["event_type"])
    return pairs.filter(F.col("l.user_id") < F.col("r.user_id")).agg(F.count("*").alias("n"), F.sum(F.col("l.lo") + F.col("r.hi")).alias("s"))


@query("jn12_scenario_vs_default", "access", sql="""WITH v AS (SELECT country_id, CASE WHEN node_id % 2 = 0 THEN 'default' ELSE 'wet' END AS scenario, avg(t_extreme) AS t FROM access GROUP BY 1, 2)
    SELECT x.country_id, round(x.t / nullif(y.t, 0), 6) AS ratio FROM v x LEFT JOIN v y ON x.country_id = y.country_id AND y.scenario = 'default' WHERE x.scenario = 'wet'""")
def scenario_vs_default(access: DataFrame) -> DataFrame:
    scenario = F.when(F.col("node_id") % 2 == 0, "default").otherwise("wet")
    v = access.groupBy("country_id", scenario.alias("scenario")).agg(F.avg("t_extreme").alias("t"))
    base = v.filter("scenario = 'default'").select("country_id", F.col("t").alias("t0"))
    return v.filter("scenario = 'wet'").join(base, "country_id", "left").select("country_id", F.round(F.try_divide("t", "t0"), 6).alias("ratio"))


@query("jn13_scenario_merge", "od", "roads", "access", sql=f"""WITH a AS (SELECT country_a AS c, count(*) AS n_pairs FROM ({OD_SQL}) x WHERE severe_increase = 1 GROUP BY 1), b AS (SELECT country_id AS c, count(*) AS n_roads FROM roads GROUP BY 1), d AS (SELECT country_id AS c, count(*) AS n_nodes FROM access GROUP BY 1)
    SELECT b.c AS country_id, coalesce(n_pairs, 0) AS n_pairs, n_roads, coalesce(n_nodes, 0) AS n_nodes FROM b LEFT JOIN a ON a.c = b.c LEFT JOIN d ON d.c = b.c""")
def scenario_merge(od: DataFrame, roads: DataFrame, access: DataFrame) -> DataFrame:
    a = od_pairs(od).filter("severe_increase = 1").groupBy(F.col("country_a").alias("country_id")).agg(F.count("*").alias("n_pairs"))
    b = roads.groupBy("country_id").agg(F.count("*").alias("n_roads"))
    d = access.groupBy("country_id").agg(F.count("*").alias("n_nodes"))
    return J.left_with_defaults(J.left_with_defaults(b, a, ["country_id"], {"n_pairs": 0}), d, ["country_id"], {"n_nodes": 0})


@query("jn17_rank_join_back", "scores", sql="SELECT s.edge_id, r.r AS ni_rank FROM scores s LEFT JOIN (SELECT edge_id, CAST(rank() OVER (ORDER BY ni DESC) AS BIGINT) AS r FROM scores WHERE cv > 0.02) r ON s.edge_id = r.edge_id")
def rank_join_back(scores: DataFrame) -> DataFrame:
    """Ranks among the slowed edges, joined to all edges; others stay NULL."""
    from netaccess.operators.ranking import value_ranks

    pool = value_ranks(scores.filter("cv > 0.02").select("edge_id", "ni"), "ni", descending=True)
    return scores.select("edge_id").join(pool.select("edge_id", F.col("min_rank").alias("ni_rank")), "edge_id", "left")


@query("jn24_pair_country_stat", "od", "access", sql="SELECT city_a, city_b, round(t, 6) AS mean_t FROM od JOIN (SELECT country_id, avg(t_normal) AS t FROM access GROUP BY country_id) c ON od.country_a = c.country_id")
def pair_country_stat(od: DataFrame, access: DataFrame) -> DataFrame:
    stat = access.groupBy(F.col("country_id").alias("country_a")).agg(F.round(F.avg("t_normal"), 6).alias("mean_t"))
    return od.join(stat, "country_a").select("city_a", "city_b", "mean_t")
