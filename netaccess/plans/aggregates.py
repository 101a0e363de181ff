"""Queries of aggregations: roll-ups, weighted statistics, coverage, inequality and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.functions import rules as R
from netaccess.operators import measures as M
from netaccess.operators.ranking import quantiles
from netaccess.plans.filters import OD_SQL, od_pairs
from netaccess.plans.registry import query

DROP = "(v_normal - v_extreme) / v_normal * 100"


@query("ag1_country_rollup", "roads", sql=f"""SELECT country_id, count(*) AS n, round(median(d), 5) AS med, round(avg(d), 5) AS mean, round(sum(d), 3) AS total, round(stddev_samp(d), 5) AS std,
    round(quantile_cont(d, 0.75), 5) AS q75, round(max(d), 5) AS most, round(avg(CASE WHEN d > 5 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 5) AS share_over_5 FROM (SELECT country_id, {DROP} AS d FROM roads) t GROUP BY country_id""")
def rollup(roads: DataFrame) -> DataFrame:
    d = roads.select("country_id", R.speed_drop_pct(F.col("v_normal"), F.col("v_extreme")).alias("d"))
    over = F.avg(F.when(F.col("d") > 5, 1.0).otherwise(0.0)) * 100
    out = {"med": F.median("d"), "mean": F.avg("d"), "std": F.stddev_samp("d"), "q75": F.percentile("d", 0.75), "most": F.max("d"), "share_over_5": over}
    return d.groupBy("country_id").agg(F.count("*").alias("n"), F.round(F.sum("d"), 3).alias("total"), *(F.round(c, 5).alias(k) for k, c in out.items()))


MEANS = {"lcc_ratio": "lcc_ratio", "bridge_ratio": "bridge_ratio", "road_deg": "road_drop", "p_block": "p_block", "e_normal": "e_normal", "e_extreme": "e_extreme", "loss_pct": "loss", "d_normal": "d_normal", "d_extreme": "d_extreme", "new_parts": "new_parts", "amp": "amp", "q_c": "q_c", "fall_at_q_c": "fall_at_q_c"}


@query("ag1_district_rollup", "districts", sql=f"""WITH d AS (SELECT *, CASE WHEN e_normal > 0 THEN (e_normal - e_extreme) / e_normal * 100 END AS loss FROM districts), a AS (SELECT *, CASE WHEN road_drop > 0 THEN loss / road_drop END AS amp FROM d)
    SELECT country_id, count(district_id) AS n_districts, CAST(sum(n_critical) AS BIGINT) AS critical_total, CAST(max(new_parts) AS BIGINT) AS new_parts_max, {", ".join(f"round(avg({c}), 5) AS {k}_mean" for k, c in MEANS.items())},
    round(median(n_nodes), 5) AS nodes_median, round(median(n_edges), 5) AS edges_median, round(stddev_samp(road_drop), 5) AS road_deg_std, round(stddev_samp(loss), 5) AS loss_pct_std, round(quantile_cont(loss, 0.75), 5) AS loss_pct_q75,
    round(median(amp), 5) AS amp_median, round(quantile_cont(amp, 0.75), 5) AS amp_q75, round(avg(CASE WHEN amp > 1 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 5) AS amp_over_1_pct, round(median(q_c), 5) AS q_c_median FROM a GROUP BY country_id""")
def district_rollup(districts: DataFrame) -> DataFrame:
    return M.district_rollup(districts, "country_id")


@query("ag2_od_by_country", "od", sql=f"SELECT country_a AS country_id, count(*) AS n, round(avg(increase_pct), 5) AS mean, round(median(increase_pct), 5) AS med, round(quantile_cont(increase_pct, 0.75), 5) AS q75, round(max(increase_pct), 5) AS most FROM ({OD_SQL}) t WHERE conn_type = 'connected' GROUP BY country_a")
def od_by_country(od: DataFrame) -> DataFrame:
    return M.five_numbers(od_pairs(od).filter("conn_type = 'connected'").withColumnRenamed("country_a", "country_id"), ["country_id"], "increase_pct")


@query("ag3_road_degradation", "roads", "country", sql=f"""SELECT row_number() OVER (ORDER BY round(m, 6) DESC, country) AS rank, country AS n_name, n AS n_road_segments, round(m, 6) AS road_mean_speed_drop_pct, round(med, 6) AS road_median_speed_drop_pct, round(p, 6) AS road_mean_p_block
    FROM (SELECT country, count(*) AS n, avg({DROP}) AS m, median({DROP}) AS med, avg(least(greatest(1 - pass_extreme, 0), 0.99)) AS p FROM roads JOIN country ON roads.country_id = country.country_id WHERE v_normal > 0 GROUP BY country) t""")
def road_degradation(roads: DataFrame, country: DataFrame) -> DataFrame:
    """Countries by their mean loss of road speed under extreme weather."""
    from netaccess.operators.ranking import global_rank

    v0, v1 = F.col("v_normal"), F.col("v_extreme")
    rows = roads.filter(v0 > 0).join(F.broadcast(country), "country_id")
    drop = R.speed_drop_pct(v0, v1)
    out = rows.groupBy(F.col("country").alias("n_name")).agg(
        F.count("*").alias("n_road_segments"), F.round(F.avg(drop), 6).alias("road_mean_speed_drop_pct"),
        F.round(F.median(drop), 6).alias("road_median_speed_drop_pct"), F.round(F.avg(R.block_probability(F.col("pass_extreme"), v0, v1)), 6).alias("road_mean_p_block"),
    )
    return global_rank(out, [F.desc("road_mean_speed_drop_pct"), F.asc("n_name")])


@query("ag4_city_isolation", "od", sql=f"""SELECT city, count(*) AS n_pairs, count(*) FILTER (WHERE conn_type = 'climate_disconnected') AS n_climate_disconnected, count(*) FILTER (WHERE conn_type = 'both_unreachable') AS n_both_unreachable,
    count(*) FILTER (WHERE conn_type = 'connected') AS n_connected, CAST(sum(severe_increase) AS BIGINT) AS n_severe, round(CAST(count(*) FILTER (WHERE conn_type = 'climate_disconnected') AS DOUBLE) / count(*), 6) AS disconnection_ratio,
    round(avg(CASE WHEN conn_type = 'connected' THEN increase_pct END), 5) AS mean_increase, round(max(CASE WHEN conn_type = 'connected' THEN increase_pct END), 5) AS max_increase
    FROM (SELECT city_a AS city, * FROM ({OD_SQL}) x UNION ALL SELECT city_b AS city, * FROM ({OD_SQL}) y) t GROUP BY city""")
def isolation(od: DataFrame) -> DataFrame:
    ends = od_pairs(od).withColumn("city", F.explode(F.array("city_a", "city_b")))
    kind = lambda k: F.count_if(F.col("conn_type") == k)
    inc = F.when(F.col("conn_type") == "connected", F.col("increase_pct"))
    return ends.groupBy("city").agg(
        F.count("*").alias("n_pairs"), kind("climate_disconnected").alias("n_climate_disconnected"), kind("both_unreachable").alias("n_both_unreachable"), kind("connected").alias("n_connected"),
        F.sum("severe_increase").alias("n_severe"), F.round(kind("climate_disconnected") / F.count("*"), 6).alias("disconnection_ratio"), F.round(F.avg(inc), 5).alias("mean_increase"), F.round(F.max(inc), 5).alias("max_increase"),
    )


@query("ag5_od_summary", "od", sql=f"""SELECT count(*) AS n, count(*) FILTER (WHERE conn_type = 'connected') AS n_connected, round(CAST(count(*) FILTER (WHERE conn_type = 'climate_disconnected') AS DOUBLE) / count(*), 6) AS climate_ratio,
    round(CAST(count(*) FILTER (WHERE conn_type = 'both_unreachable') AS DOUBLE) / count(*), 6) AS both_ratio, round(avg(increase_pct), 5) AS mean, round(median(increase_pct), 5) AS med, round(quantile_cont(increase_pct, 0.75), 5) AS q75,
    round(CAST(sum(severe_increase) AS DOUBLE) / count(*), 6) AS severe_share FROM ({OD_SQL}) t""")
def od_summary(od: DataFrame) -> DataFrame:
    return M.od_summary(od_pairs(od), [])


@query("ag6_continent_totals", "roads", "country", sql=f"""SELECT region, CAST(sum(n) AS BIGINT) AS n, round(avg(m), 5) AS mean_of_means, round(median(md), 5) AS median_of_medians FROM
    (SELECT country_id, count(*) AS n, avg({DROP}) AS m, median({DROP}) AS md FROM roads GROUP BY country_id) t JOIN country c ON t.country_id = c.country_id GROUP BY region""")
def continent(roads: DataFrame, country: DataFrame) -> DataFrame:
    d = R.speed_drop_pct(F.col("v_normal"), F.col("v_extreme"))
    t = roads.groupBy("country_id").agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.median(d).alias("md"))
    return t.join(country, "country_id").groupBy("region").agg(F.sum("n").alias("n"), F.round(F.avg("m"), 5).alias("mean_of_means"), F.round(F.median("md"), 5).alias("median_of_medians"))


WQ = """WITH s AS (SELECT country_id, t_normal AS t, population AS w, sum(population) OVER (PARTITION BY country_id ORDER BY t_normal, node_id) AS upto, sum(population) OVER (PARTITION BY country_id) AS total FROM access WHERE t_normal IS NOT NULL AND population > 0)
    SELECT country_id, round(sum(t * w) / sum(w), 6) AS mean, """ + ", ".join(f"round(min(CASE WHEN upto >= {q} * total THEN t END), 6) AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM s GROUP BY country_id"


@query("ag7_weighted_stats", "access", sql=WQ)
def weighted_stats(access: DataFrame) -> DataFrame:
    return M.weighted_stats(access, ["country_id"], "t_normal", "population", "node_id", (0.1, 0.5, 0.9))


@query("ag7_unreachable_share", "access", sql="SELECT country_id, round(100.0::DOUBLE * count(*) FILTER (WHERE t_normal IS NULL OR population <= 0) / count(*), 5) AS pct_unreachable FROM access GROUP BY country_id")
def unreachable_share(access: DataFrame) -> DataFrame:
    out = F.count_if(F.col("t_normal").isNull() | (F.col("population") <= 0))
    return access.groupBy("country_id").agg(F.round(100 * out / F.count("*"), 5).alias("pct_unreachable"))


@query("ag8_weighted_quantile", "access", sql="WITH s AS (SELECT t_extreme AS t, sum(population) OVER (ORDER BY t_extreme, node_id) AS upto, sum(population) OVER () AS total FROM access WHERE t_extreme IS NOT NULL AND population > 0) SELECT round(min(CASE WHEN upto >= 0.5 * total THEN t END), 6) AS p50, round(min(CASE WHEN upto >= 0.9 * total THEN t END), 6) AS p90 FROM s")
def weighted_quantile(access: DataFrame) -> DataFrame:
    return M.weighted_quantiles_overall(access, "t_extreme", "population", "node_id", (0.5, 0.9))


@query("ag9_weighted_mean", "access", sql="SELECT country_id, round(sum(CASE WHEN population > 0 THEN t_extreme * population END) / nullif(sum(CASE WHEN population > 0 AND t_extreme IS NOT NULL THEN population END), 0), 6) AS mean FROM access GROUP BY country_id")
def weighted_mean(access: DataFrame) -> DataFrame:
    return access.groupBy("country_id").agg(F.round(M.weighted_mean("t_extreme", "population"), 6).alias("mean"))


ISO = ", ".join(f"round(coalesce(sum(CASE WHEN t_normal < {h} THEN population END), 0), 2) AS n_{int(h * 60)}, round(coalesce(sum(CASE WHEN t_extreme < {h} THEN population END), 0), 2) AS e_{int(h * 60)}, round(coalesce(sum(CASE WHEN t_normal < {h} THEN population END) / nullif(sum(population), 0) * 100, 0), 5) AS pn_{int(h * 60)}, round(coalesce(sum(CASE WHEN t_extreme < {h} THEN population END) / nullif(sum(population), 0) * 100, 0), 5) AS pe_{int(h * 60)}" for h in C.ISOCHRONE_HOURS)


@query("ag10_isochrones", "access", sql=f"SELECT country_id, {ISO} FROM access GROUP BY country_id")
def isochrones(access: DataFrame) -> DataFrame:
    return M.isochrones(access, ["country_id"], C.ISOCHRONE_HOURS)


GINI = "WITH s AS (SELECT country_id, t_normal AS x, row_number() OVER (PARTITION BY country_id ORDER BY t_normal, node_id) AS i, count(*) OVER (PARTITION BY country_id) AS n FROM access WHERE t_normal >= 0) SELECT country_id, round((2 * sum(i * x) / (max(n) * sum(x))) - CAST(max(n) + 1 AS DOUBLE) / max(n), 6) AS gini FROM s GROUP BY country_id HAVING max(n) >= 2"


@query("ag11_gini", "access", sql=GINI)
def gini(access: DataFrame) -> DataFrame:
    return M.gini(access, ["country_id"], "t_normal", "node_id")


REP = "SELECT country_id, t_normal AS t, CAST(least(greatest(round(population / mp), 1), 500) AS BIGINT) AS k FROM (SELECT *, min(population) OVER (PARTITION BY country_id) AS mp FROM access WHERE t_normal IS NOT NULL AND population > 0) a"


@query("ag12_replicated_gini", "access", sql=f"""WITH r AS ({REP}), c AS (SELECT country_id, t, CAST(sum(k) AS DOUBLE) AS k FROM r GROUP BY country_id, t), s AS (SELECT country_id, t, k, sum(k) OVER (PARTITION BY country_id ORDER BY t) AS upto, sum(k) OVER (PARTITION BY country_id) AS n FROM c)
    SELECT country_id, round(2 * sum(t * k * (upto - (k - 1) / 2)) / (max(n) * sum(t * k)) - (max(n) + 1) / max(n), 6) AS gini, CAST(max(n) AS BIGINT) AS n FROM s GROUP BY country_id HAVING max(n) >= 10""")
def replicated_gini(access: DataFrame) -> DataFrame:
    return M.replicated_gini(access, ["country_id"], "t_normal", "population")


def side(c: str) -> str:
    """A ranked side of the bundle's twin."""
    return f"sum(k) OVER (PARTITION BY country_id ORDER BY {c}) - (sum(k) OVER (PARTITION BY country_id, {c}) - 1) / 2.0::DOUBLE AS r{c}"


BUNDLE = f"""rows AS (SELECT country_id, t_normal AS a, t_extreme AS b, t_extreme - t_normal AS d, population AS w, CAST(least(greatest(round_even(population / min(population) OVER (PARTITION BY country_id), 0), 1), 500) AS BIGINT) AS k FROM access WHERE t_normal IS NOT NULL AND t_extreme IS NOT NULL AND population > 0),
    x AS (SELECT *, {side('a')}, {side('b')}, {side('d')}, sum(w) OVER (PARTITION BY country_id ORDER BY d) AS upto, sum(w) OVER (PARTITION BY country_id) AS total FROM rows),
    f AS (SELECT country_id, count(*) AS n, 2 * sum(k * a * ra) / (sum(k) * sum(k * a)) - (sum(k) + 1) / CAST(sum(k) AS DOUBLE) AS ga, 2 * sum(k * b * rb) / (sum(k) * sum(k * b)) - (sum(k) + 1) / CAST(sum(k) AS DOUBLE) AS gb,
        (sum(k * ra * rd) - sum(k * ra) * sum(k * rd) / sum(k)) / sqrt((sum(k * ra * ra) - sum(k * ra) * sum(k * ra) / sum(k)) * (sum(k * rd * rd) - sum(k * rd) * sum(k * rd) / sum(k))) AS rho, min(CASE WHEN upto >= 0.5 * total THEN d END) AS p50, min(CASE WHEN upto >= 0.9 * total THEN d END) AS p90 FROM x GROUP BY country_id)"""


@query("ag12_inequality_bundle", "access", sql=f"WITH {BUNDLE} SELECT country_id, n, round(CASE WHEN n >= 10 THEN ga END, 6) AS gini_normal, round(CASE WHEN n >= 10 THEN gb END, 6) AS gini_extreme, round(CASE WHEN n >= 10 THEN gb - ga END, 6) AS delta_gini, round(CASE WHEN n >= 10 THEN rho END, 6) AS spearman_rho, round(CASE WHEN n >= 10 THEN p50 END, 6) AS p50_delta, round(CASE WHEN n >= 10 THEN p90 END, 6) AS p90_delta, round(CASE WHEN n >= 10 AND p50 > 0 THEN p90 / p50 END, 5) AS tail_ratio FROM f")
def inequality_bundle(access: DataFrame) -> DataFrame:
    out = M.inequality_bundle(access, "country_id", "t_normal", "t_extreme", "population")
    return out.select("country_id", "n", *(F.round(c, 5 if c == "tail_ratio" else 6).alias(c) for c in out.columns[2:]))


@query("ag13_inequality_summary", "access", "country", sql=f"WITH {BUNDLE}, p AS (SELECT country_id, sum(population) AS pop, sum(t_normal * population) / sum(population) AS t0, sum(t_extreme * population) / sum(population) AS t1 FROM access WHERE t_normal IS NOT NULL AND t_extreme IS NOT NULL AND population > 0 GROUP BY country_id) SELECT region, count(*) AS n_countries, round(sum(pop), 2) AS population, round(sum(t0 * pop) / sum(pop), 5) AS t_normal, round(sum(t1 * pop) / sum(pop), 5) AS t_extreme, round(sum(ga * pop) / sum(pop), 5) AS gini_normal, round(sum(gb * pop) / sum(pop), 5) AS gini_extreme, round(median(rho), 5) AS median_rho, round(avg(CASE WHEN p50 > 0 THEN p90 / p50 END), 5) AS tail_ratio FROM f JOIN p ON f.country_id = p.country_id JOIN country ON f.country_id = country.country_id WHERE n >= 10 GROUP BY region")
def inequality_summary(access: DataFrame, country: DataFrame) -> DataFrame:
    """The countries' bundles by region, weighted by population."""
    bundle = M.inequality_bundle(access, "country_id", "t_normal", "t_extreme", "population").filter("n >= 10")
    rows = access.filter("t_normal IS NOT NULL AND t_extreme IS NOT NULL AND population > 0")
    mean = lambda c: (F.sum(F.col(c) * F.col("population")) / F.sum("population")).alias(c)
    means = rows.groupBy("country_id").agg(F.sum("population").alias("pop"), mean("t_normal"), mean("t_extreme"))
    c = bundle.join(means, "country_id").join(country.select("country_id", "region"), "country_id")
    weighted = lambda x: F.round(F.sum(F.col(x) * F.col("pop")) / F.sum("pop"), 5).alias(x)
    return c.groupBy("region").agg(
        F.count("*").alias("n_countries"), F.round(F.sum("pop"), 2).alias("population"), *map(weighted, ("t_normal", "t_extreme", "gini_normal", "gini_extreme")), F.round(F.median("spearman_rho"), 5).alias("median_rho"), F.round(F.avg("tail_ratio"), 5).alias("tail_ratio"),
    )


@query("ag13_weighted_summary", "access", "country", sql="WITH c AS (SELECT country_id, avg(t_normal) AS t, sum(population) AS pop, corr(t_normal, population) AS r FROM access GROUP BY country_id) SELECT region, round(sum(t * pop) / sum(pop), 5) AS t, round(median(r), 5) AS r FROM c JOIN country ON c.country_id = country.country_id GROUP BY region")
def weighted_summary(access: DataFrame, country: DataFrame) -> DataFrame:
    c = access.groupBy("country_id").agg(F.avg("t_normal").alias("t"), F.sum("population").alias("pop"), F.corr("t_normal", "population").alias("r"))
    return c.join(country, "country_id").groupBy("region").agg(F.round(M.weighted_mean("t", "pop"), 5).alias("t"), F.round(F.median("r"), 5).alias("r"))


@query("ag14_grid_means", "access", sql="SELECT CAST(floor(lon / 2) AS BIGINT) AS cx, CAST(floor(lat / 2) AS BIGINT) AS cy, count(*) AS n, round(sum(t_normal * population) / sum(CASE WHEN t_normal IS NOT NULL THEN population END), 6) AS pw_t, round(sum(population), 2) AS pop FROM access WHERE population > 0 GROUP BY 1, 2")
def grid_means(access: DataFrame) -> DataFrame:
    from netaccess.operators.joining import cells

    return cells(access.filter("population > 0"), 2.0).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.round(M.weighted_mean("t_normal", "population"), 6).alias("pw_t"), F.round(F.sum("population"), 2).alias("pop"))


@query("ag15_facility_counts", "facilities", sql="SELECT CAST(floor(lon / 2) AS BIGINT) AS cx, CAST(floor(lat / 2) AS BIGINT) AS cy, count(*) AS n FROM facilities GROUP BY 1, 2")
def facility_counts(facilities: DataFrame) -> DataFrame:
    from netaccess.operators.joining import cells

    return cells(facilities, 2.0).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("ag17_medians_shares", "access", sql="SELECT round(median(m), 5) AS med, round(avg(m), 5) AS mean, count(*) FILTER (WHERE m > 0.3) AS n_over, round(avg(CASE WHEN m > 0.3 THEN 1.0::DOUBLE ELSE 0.0 END), 5) AS share FROM (SELECT avg(t_extreme - t_normal) AS m FROM access GROUP BY country_id) t")
def medians_shares(access: DataFrame) -> DataFrame:
    m = access.groupBy("country_id").agg(F.avg(F.col("t_extreme") - F.col("t_normal")).alias("m"))
    over = F.col("m") > 0.3
    return m.agg(F.round(F.median("m"), 5).alias("med"), F.round(F.avg("m"), 5).alias("mean"), F.count_if(over).alias("n_over"), F.round(F.avg(F.when(over, 1.0).otherwise(0.0)), 5).alias("share"))


@query("ag18_quadrants", "access", "country", sql="""WITH c AS (SELECT country, avg(t_normal) AS x, avg(population) AS y FROM access a JOIN country c ON a.country_id = c.country_id GROUP BY country), m AS (SELECT median(x) AS mx, median(y) AS my FROM c)
    SELECT CASE WHEN x >= mx AND y >= my THEN 'HH' WHEN x >= mx THEN 'HL' WHEN y >= my THEN 'LH' ELSE 'LL' END AS quadrant, count(*) AS n, string_agg(country, ',' ORDER BY country) AS members, round(avg(x), 5) AS mean, round(median(x), 5) AS med FROM c, m GROUP BY 1""")
def quadrants(access: DataFrame, country: DataFrame) -> DataFrame:
    c = access.join(country, "country_id").groupBy("country").agg(F.avg("t_normal").alias("x"), F.avg("population").alias("y"))
    return M.quadrants(c, "country", "x", "y")


@query("ag19_two_by_two", "scores", sql="""WITH u AS (SELECT * FROM scores WHERE cv > 0.02), m AS (SELECT median(ni) AS a, median(cv) AS b FROM u) SELECT ni > a AS high_ni, cv > b AS high_cv, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM u), 5) AS pct, round(avg(ni), 4) AS mean_ni, round(avg(cv), 6) AS mean_cv FROM u, m GROUP BY 1, 2""")
def two_by_two(scores: DataFrame) -> DataFrame:
    u = scores.filter(F.col("cv") > C.CV_MIN)
    m = F.broadcast(quantiles(u, {"a": (F.col("ni"), (0.5,)), "b": (F.col("cv"), (0.5,))}))
    rows = u.crossJoin(m).crossJoin(F.broadcast(u.agg(F.count("*").alias("total")))).groupBy((F.col("ni") > F.col("a_0")).alias("high_ni"), (F.col("cv") > F.col("b_0")).alias("high_cv"))
    return rows.agg(F.count("*").alias("n"), F.round(100.0 * F.count("*") / F.max("total"), 5).alias("pct"), F.round(F.avg("ni"), 4).alias("mean_ni"), F.round(F.avg("cv"), 6).alias("mean_cv"))


@query("ag20_value_counts", "od", sql="SELECT country_a AS country_id, count(*) AS n FROM (SELECT * FROM od WHERE t0 IS NOT NULL ORDER BY t0 DESC, city_a, city_b LIMIT 50) t GROUP BY 1")
def value_counts(od: DataFrame) -> DataFrame:
    return od.filter("t0 IS NOT NULL").orderBy(F.desc("t0"), "city_a", "city_b").limit(50).groupBy(F.col("country_a").alias("country_id")).agg(F.count("*").alias("n"))


@query("ag21_constant_and_means", "access", "country", sql="SELECT a.country_id, min(country) AS country, round(avg(t_normal), 6) AS mean, count(*) AS n FROM access a JOIN country c ON a.country_id = c.country_id GROUP BY a.country_id")
def constant_means(access: DataFrame, country: DataFrame) -> DataFrame:
    return access.join(country, "country_id").groupBy("country_id").agg(F.min("country").alias("country"), F.round(F.avg("t_normal"), 6).alias("mean"), F.count("*").alias("n"))


@query("ag22_threshold_curve", "access", sql=" UNION ALL ".join(f"SELECT {h}::DOUBLE AS hours, round(avg(CASE WHEN t_normal < {h} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS plain, round(sum(CASE WHEN t_normal < {h} THEN population ELSE 0 END) / sum(population), 6) AS weighted FROM access" for h in C.ISOCHRONE_HOURS))
def threshold_curve(access: DataFrame) -> DataFrame:
    hours = F.explode(F.array(*map(F.lit, C.ISOCHRONE_HOURS))).alias("hours")
    inside = F.coalesce(F.col("t_normal") < F.col("hours"), F.lit(False))
    rows = access.select("t_normal", "population", hours).withColumn("in", F.when(inside, 1.0).otherwise(0.0))
    return rows.groupBy("hours").agg(F.round(F.avg("in"), 6).alias("plain"), F.round(F.sum(F.col("in") * F.col("population")) / F.sum("population"), 6).alias("weighted"))


@query("ag23_either_endpoint", "od", sql=f"""SELECT country_id, count(*) AS n, count(*) FILTER (WHERE severe_increase = 1) AS n_severe FROM (SELECT country_a AS country_id, severe_increase FROM ({OD_SQL}) x UNION ALL SELECT country_b, severe_increase FROM ({OD_SQL}) y WHERE country_a <> country_b) t GROUP BY country_id""")
def either_endpoint(od: DataFrame) -> DataFrame:
    """A pair counts once for each country that it touches."""
    ends = od_pairs(od).select(F.explode(F.array_distinct(F.array("country_a", "country_b"))).alias("country_id"), "severe_increase")
    return ends.groupBy("country_id").agg(F.count("*").alias("n"), F.count_if(F.col("severe_increase") == 1).alias("n_severe"))


@query("ag24_weighted_histogram", "pixels", sql="SELECT CAST(floor(lat) AS BIGINT) AS bin, round(sum(pop), 3) AS total FROM pixels GROUP BY 1")
def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(F.floor("lat").alias("bin")).agg(F.round(F.sum("pop"), 3).alias("total"))


@query("ag25_bincount", "country", "scores", sql="SELECT c.country_id, count(s.edge_id) AS n FROM country c LEFT JOIN (SELECT * FROM scores ORDER BY ni DESC, edge_id LIMIT 500) s ON c.country_id = s.country_id GROUP BY c.country_id")
def bincount(country: DataFrame, scores: DataFrame) -> DataFrame:
    top = scores.orderBy(F.desc("ni"), "edge_id").limit(C.TOP_K).select("country_id", "edge_id")
    return country.join(top, "country_id", "left").groupBy("country_id").agg(F.count("edge_id").alias("n"))


@query("ag26_range_and_nearest", "access", sql="SELECT country_id, round(min(t_normal), 6) AS low, round(max(t_normal), 6) AS high, round(max(t_normal) - min(t_normal), 6) AS range, arg_min(node_id, abs(t_normal - 1) * 1e6 + CAST(node_id AS DOUBLE) / 1e9) AS nearest FROM access GROUP BY country_id")
def range_nearest(access: DataFrame) -> DataFrame:
    t, gap = F.col("t_normal"), F.abs(F.col("t_normal") - 1) * 1e6 + F.col("node_id").cast("double") / 1e9
    return access.groupBy("country_id").agg(F.round(F.min(t), 6).alias("low"), F.round(F.max(t), 6).alias("high"), F.round(F.max(t) - F.min(t), 6).alias("range"), F.min_by("node_id", gap).alias("nearest"))


@query("ag28_distinct_counts", "od", sql="SELECT count(DISTINCT city_a) AS n_a, count(DISTINCT city_b) AS n_b, count(DISTINCT country_a) AS n_countries FROM od")
def distinct_counts(od: DataFrame) -> DataFrame:
    return od.agg(F.countDistinct("city_a").alias("n_a"), F.countDistinct("city_b").alias("n_b"), F.countDistinct("country_a").alias("n_countries"))


@query("ag29_positive_summary", "pixels", sql="SELECT count(*) AS n, round(min(pop), 4) AS low, round(max(pop), 4) AS high, round(avg(pop), 4) AS mean, count(*) FILTER (WHERE pop = 0) AS n_zero, " + ", ".join(f"round(quantile_cont(CASE WHEN pop > 0 THEN pop END, {q}), 4) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM pixels")
def positive_summary(pixels: DataFrame) -> DataFrame:
    p, pos = F.col("pop"), F.when(F.col("pop") > 0, F.col("pop"))
    shares = (0.5, 0.9, 0.95, 0.99)
    cuts = quantiles(pixels, {"p": (pos, shares)}).select(*(F.round(f"p_{i}", 4).alias(f"p{int(q * 100)}") for i, q in enumerate(shares)))
    rest = pixels.agg(F.count("*").alias("n"), F.round(F.min(p), 4).alias("low"), F.round(F.max(p), 4).alias("high"), F.round(F.avg(p), 4).alias("mean"), F.count_if(p == 0).alias("n_zero"))
    return rest.crossJoin(F.broadcast(cuts))


@query("ag32_monthly_sum", "events", sql="SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def monthly(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("month", "ts").cast("date").alias("month"), "event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@query("ag33_per_cell_reduction", "climate", sql="SELECT c.cell_id, round(avg(mrso), 6) AS mean, round(max(p75), 6) AS p75, round(max(p95), 6) AS p95, round(avg(CASE WHEN mrso <= p75 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM climate c JOIN (SELECT cell_id, quantile_cont(mrso, 0.75) AS p75, quantile_cont(mrso, 0.95) AS p95 FROM climate GROUP BY cell_id) q ON c.cell_id = q.cell_id GROUP BY c.cell_id")
def reduction(climate: DataFrame) -> DataFrame:
    out = M.moisture_stats(climate)
    return out.select("cell_id", *(F.round(c, 6).alias(c) for c in ("mean", "p75", "p95", "share")))


@query("ag27_by_label", "scores", sql="SELECT CASE WHEN ni > 100000 THEN 'high' WHEN ni > 50000 THEN 'middle' ELSE 'low' END AS label, round(avg(cv), 6) AS mean, round(min(cv), 6) AS low, round(max(cv), 6) AS high FROM scores GROUP BY 1")
def by_label(scores: DataFrame) -> DataFrame:
    label = F.when(F.col("ni") > 100_000, "high").when(F.col("ni") > 50_000, "middle").otherwise("low")
    return scores.groupBy(label.alias("label")).agg(*(F.round(f("cv"), 6).alias(k) for k, f in (("mean", F.avg), ("low", F.min), ("high", F.max))))


@query("ag30_scenario_summary", "climate", sql="SELECT CAST(extract(year FROM month) AS INT) AS scenario, count(*) AS n_rows, round(avg(pr), 5) AS mean_pr, round(avg(mrso), 5) AS mean_mrso FROM climate GROUP BY 1")
def scenario_summary(climate: DataFrame) -> DataFrame:
    return climate.groupBy(F.year("month").alias("scenario")).agg(F.count("*").alias("n_rows"), F.round(F.avg("pr"), 5).alias("mean_pr"), F.round(F.avg("mrso"), 5).alias("mean_mrso"))


@query("ag31_headline_summary", "access", sql="WITH c AS (SELECT country_id, sum(population) AS pop, sum(CASE WHEN t_normal < 1 THEN population ELSE 0 END) - sum(CASE WHEN t_extreme < 1 THEN population ELSE 0 END) AS lost, corr(t_normal, t_extreme) AS r FROM access GROUP BY country_id) SELECT round(sum(lost) / sum(pop) * 100, 5) AS weighted_loss, round(avg(lost / nullif(pop, 0)) * 100, 5) AS mean_loss, count(*) FILTER (WHERE lost > 0) AS n_losing, round(median(r), 5) AS median_r FROM c")
def headline(access: DataFrame) -> DataFrame:
    """The loss of coverage both ways: weighted by population, and as a mean of countries."""
    inside = lambda t: F.sum(F.when(F.col(t) < 1, F.col("population")).otherwise(0.0))
    c = access.groupBy("country_id").agg(F.sum("population").alias("pop"), (inside("t_normal") - inside("t_extreme")).alias("lost"), F.corr("t_normal", "t_extreme").alias("r"))
    return c.agg(F.round(F.sum("lost") / F.sum("pop") * 100, 5).alias("weighted_loss"), F.round(F.avg(F.try_divide("lost", "pop")) * 100, 5).alias("mean_loss"), F.count_if(F.col("lost") > 0).alias("n_losing"), F.round(F.median("r"), 5).alias("median_r"))
