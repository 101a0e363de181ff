"""Queries of scenarios, stability, sensitivity and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.functions import rules as R
from netaccess.operators import scenarios as S
from netaccess.operators import sets as K
from netaccess.operators.ranking import quantiles
from netaccess.plans.registry import query


@query("sm1_paving_curve", "od", "places", "scores", sql=f"""WITH m AS (SELECT t0, t1, CAST(a.pop_max AS DOUBLE) * b.pop_max / 1e9 AS mass FROM od JOIN places a ON city_a = a.place_id JOIN places b ON city_b = b.place_id WHERE t0 > 0 AND t1 >= t0),
    n AS (SELECT count(*) AS n, sum(ni * cv) AS total FROM scores), r AS (SELECT row_number() OVER (ORDER BY ni * cv DESC, edge_id) AS r, ni * cv AS s FROM scores),
    f AS (SELECT f AS fraction, CAST(round_even(f * n, 0) AS BIGINT) AS n_edges, total FROM n, (VALUES {", ".join(f"({f}::DOUBLE)" for f in C.PAVING_FRACTIONS)}) x(f)),
    e AS (SELECT fraction, n_edges, coalesce((SELECT sum(s) FROM r WHERE r.r <= f.n_edges), 0) / total AS relief FROM f),
    a AS (SELECT fraction, n_edges, sum(mass / (t1 - (t1 - t0) * relief)) AS a FROM m, e GROUP BY fraction, n_edges), b AS (SELECT sum(mass / t0) AS an, sum(mass / t1) AS ae FROM m)
    SELECT fraction, n_edges, round(CASE WHEN an - ae > 1e-12 THEN (a - ae) / (an - ae) ELSE 0 END, 5) AS recovery FROM a, b""")
def paving(od: DataFrame, places: DataFrame, scores: DataFrame) -> DataFrame:
    """Recovery of gravity accessibility as the worst edges are paved; a step relieves pairs by its share of the total score."""
    from netaccess.operators.ranking import running_sum

    pop = lambda k: places.select(F.col("place_id").alias(f"city_{k}"), F.col("pop_max").cast("double").alias(f"p{k}"))
    pairs = od.filter("t0 > 0 AND t1 >= t0").join(pop("a"), "city_a").join(pop("b"), "city_b").withColumn("mass", F.col("pa") * F.col("pb") / 1e9)
    s = scores.select("edge_id", (F.col("ni") * F.col("cv")).alias("s"))
    order = [F.desc("s"), F.asc("edge_id")]
    summed = running_sum(running_sum(s, order, F.lit(1), "r"), order, F.col("s"), "upto")
    n = scores.agg(F.count("*").alias("n"), F.sum(F.col("ni") * F.col("cv")).alias("total"))
    steps = n.withColumn("fraction", F.explode(F.array(*map(F.lit, C.PAVING_FRACTIONS)))).withColumn("n_edges", F.bround(F.col("fraction") * F.col("n")).cast("bigint"))
    steps = steps.join(summed.select(F.col("r").alias("n_edges"), "upto"), "n_edges", "left").select("fraction", "n_edges", (F.coalesce("upto", F.lit(0.0)) / F.col("total")).alias("relief"))
    ends = F.broadcast(pairs.agg(F.sum(F.col("mass") / F.col("t0")).alias("an"), F.sum(F.col("mass") / F.col("t1")).alias("ae")))
    gain = F.col("an") - F.col("ae")
    out = S.patched_access(pairs, steps).crossJoin(ends)
    return out.select("fraction", "n_edges", F.round(F.when(gain > 1e-12, (F.col("a") - F.col("ae")) / gain).otherwise(0.0), 5).alias("recovery"))


@query("sm3_score_variants", "scores", sql="""WITH m AS (SELECT max(ni) AS mn, max(cv) AS mc FROM scores), g AS (SELECT edge_id, alpha, ni, cv, ni / mn AS a, cv / mc AS b FROM scores, m, (VALUES (1.5::DOUBLE), (2.0), (2.5)) x(alpha)),
    f AS (SELECT edge_id, 'raw' AS variant, alpha, pow(ni, alpha / 2) * cv AS score FROM g UNION ALL SELECT edge_id, 'product', alpha, pow(a, alpha / 2) * b FROM g UNION ALL SELECT edge_id, 'additive', alpha, pow(a, alpha / 2) + b FROM g)
    SELECT variant, alpha, count(*) AS n, round(avg(score), 4) AS mean FROM f GROUP BY variant, alpha""")
def score_variants(scores: DataFrame) -> DataFrame:
    return S.score_variants(scores, C.SCORE_ALPHAS).groupBy("variant", "alpha").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query("sm3_rank_sum", "scores", sql="""WITH r AS (SELECT edge_id, rank() OVER (ORDER BY ni DESC) + (count(*) OVER (PARTITION BY ni) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY cv DESC) + (count(*) OVER (PARTITION BY cv) - 1) / 2.0::DOUBLE AS b, count(*) OVER () AS n FROM scores) SELECT edge_id, round((a + b) / n, 6) AS rank_sum FROM r""")
def rank_sum(scores: DataFrame) -> DataFrame:
    return S.rank_sum(scores).select("edge_id", F.round("rank_sum", 6).alias("rank_sum"))


@query("sm4_top_share_stability", "scores", sql=" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, round(CAST(count(*) FILTER (WHERE a.edge_id IS NOT NULL AND b.edge_id IS NOT NULL) AS DOUBLE) / count(*), 6) AS jaccard FROM (SELECT edge_id FROM (SELECT edge_id, row_number() OVER (ORDER BY ni * cv DESC, edge_id) AS r, count(*) OVER () AS n FROM scores) t WHERE r <= floor(n * {s})) a FULL JOIN (SELECT edge_id FROM (SELECT edge_id, row_number() OVER (ORDER BY ni * pow(cv, 2) DESC, edge_id) AS r, count(*) OVER () AS n FROM scores) t WHERE r <= floor(n * {s})) b ON a.edge_id = b.edge_id" for s in C.SHARES))
def stability(scores: DataFrame) -> DataFrame:
    """Overlap of the leading shares of two score forms, from one pair of ranks."""
    from netaccess.operators.ranking import global_rank

    n = F.broadcast(scores.agg(F.count("*").alias("n")))
    forms = {"ra": F.col("ni") * F.col("cv"), "rb": F.col("ni") * F.pow("cv", F.lit(2))}
    ranked = None
    for name, form in forms.items():
        r = global_rank(scores.select("edge_id", form.alias("s")), [F.desc("s"), F.asc("edge_id")], name).select("edge_id", name)
        ranked = r if ranked is None else ranked.join(r, "edge_id")
    rows = ranked.crossJoin(n).withColumn("share", F.explode(F.array(*map(F.lit, C.SHARES)))).withColumn("k", F.floor(F.col("n") * F.col("share")))
    a, b = F.col("ra") <= F.col("k"), F.col("rb") <= F.col("k")
    return rows.groupBy("share").agg(F.round(F.try_divide(F.count_if(a & b), F.count_if(a | b)), 6).alias("jaccard"))


@query("sm6_future_slowdown", "roads", sql="SELECT road_id, round(greatest(greatest(v_normal, 0.5) / (greatest(v_extreme * 0.9, 0.5) * (1 - least(greatest(1 - pass_extreme, 0), 0.99))) - 1, 0), 6) AS cv FROM roads")
def future(roads: DataFrame) -> DataFrame:
    return roads.select("road_id", F.round(S.future_slowdown(F.col("v_normal"), F.col("v_extreme") * 0.9, 1 - F.col("pass_extreme")), 6).alias("cv"))


@query("sm8_strategic_mask", "scores", sql="WITH m AS (SELECT median(CASE WHEN ni * cv > 0 THEN ni * cv END) AS b FROM scores) SELECT edge_id, ni * cv >= b AS strategic FROM scores, m")
def strategic(scores: DataFrame) -> DataFrame:
    s = F.col("ni") * F.col("cv")
    m = F.broadcast(quantiles(scores, {"b": (F.when(s > 0, s), (0.5,))}))
    return scores.crossJoin(m).select("edge_id", (s >= F.col("b_0")).alias("strategic"))


@query("sm9_capture_share", "scores", sql="WITH t AS (SELECT ni * cv AS s FROM scores ORDER BY ni DESC, edge_id LIMIT 500) SELECT round((SELECT sum(s) FROM t) / sum(ni * cv), 6) AS share, round(500.0::DOUBLE / count(*), 6) AS expected FROM scores")
def capture(scores: DataFrame) -> DataFrame:
    return S.capture_share(scores.withColumn("s", F.col("ni") * F.col("cv")), F.desc("ni"), "s", C.TOP_K)


@query("sm10_hotspot_overlap", "scores", sql="""WITH a AS (SELECT country_id, count(*) AS n FROM (SELECT * FROM scores ORDER BY ni DESC, edge_id LIMIT 500) t GROUP BY country_id ORDER BY n DESC, country_id LIMIT 10), b AS (SELECT country_id, count(*) AS n FROM (SELECT * FROM scores ORDER BY ni * cv DESC, edge_id LIMIT 500) t GROUP BY country_id ORDER BY n DESC, country_id LIMIT 10)
    SELECT round(CAST(count(*) FILTER (WHERE a.country_id IS NOT NULL AND b.country_id IS NOT NULL) AS DOUBLE) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.country_id = b.country_id""")
def hotspots(scores: DataFrame) -> DataFrame:
    def leading(df: DataFrame, value: str) -> DataFrame:
        return K.top_k(df, value, "edge_id", C.TOP_K).groupBy("country_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_id").limit(10)

    return K.jaccard(leading(scores, "ni"), leading(scores.withColumn("s", F.col("ni") * F.col("cv")), "s"), ["country_id"])


@query("sm12_paved_weights", "edges", sql="SELECT road_id, round(CASE WHEN abs(w0 - w1) <= 1e-12 + 1e-10 * abs(w1) THEN w0 * (SELECT median(length_km / w0) FROM edges) / 80 ELSE w0 END, 6) AS w0, round(CASE WHEN abs(w0 - w1) <= 1e-12 + 1e-10 * abs(w1) THEN w0 * (SELECT median(length_km / w0) FROM edges) / 80 * 1.1 ELSE w1 END, 6) AS w1 FROM edges")
def paved(edges: DataFrame) -> DataFrame:
    m = F.broadcast(quantiles(edges, {"m": (F.col("length_km") / F.col("w0"), (0.5,))}))
    flat, new = R.neutral(F.col("w0"), F.col("w1")), F.col("w0") * F.col("m_0") / C.PAVED_SPEEDS[0]
    return edges.crossJoin(m).select("road_id", F.round(F.when(flat, new).otherwise(F.col("w0")), 6).alias("w0"), F.round(F.when(flat, new * 1.1).otherwise(F.col("w1")), 6).alias("w1"))


@query("sm14_severity_factor", "climate", sql="WITH s AS (SELECT CAST(extract(year FROM month) AS INT) AS y, avg(pr) AS m FROM climate GROUP BY 1) SELECT y, round(m / (SELECT m FROM s WHERE y = 1996), 6) AS factor FROM s")
def severity(climate: DataFrame) -> DataFrame:
    s = climate.groupBy(F.year("month").alias("y")).agg(F.avg("pr").alias("m"))
    base = F.broadcast(s.filter("y = 1996").select(F.col("m").alias("base")))
    return s.crossJoin(base).select("y", F.round(F.try_divide("m", "base"), 6).alias("factor"))


@query("sm16_clipped_proxy", "access", sql="WITH c AS (SELECT country_id, avg(t_normal) AS a, avg(t_extreme) AS b FROM access GROUP BY country_id) SELECT country_id, round(least(greatest((b - a) / nullif(a, 0) * 10, 0), 20), 6) AS proxy, round(least(greatest(b / nullif(a, 0), 0.25), 4), 6) AS tail FROM c")
def proxy(access: DataFrame) -> DataFrame:
    c = access.groupBy("country_id").agg(F.avg("t_normal").alias("a"), F.avg("t_extreme").alias("b"))
    clip = lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return c.select("country_id", F.round(clip(F.try_divide(F.col("b") - F.col("a"), F.col("a")) * 10, 0.0, 20.0), 6).alias("proxy"), F.round(clip(F.try_divide("b", "a"), 0.25, 4.0), 6).alias("tail"))


@query("sm18_pivot", "scores", sql="SELECT country_id, round(avg(CASE WHEN edge_id % 3 = 0 THEN ni END), 4) AS g0, round(avg(CASE WHEN edge_id % 3 = 1 THEN ni END), 4) AS g1, round(avg(CASE WHEN edge_id % 3 = 2 THEN ni END), 4) AS g2 FROM scores GROUP BY country_id")
def pivot(scores: DataFrame) -> DataFrame:
    g = F.concat(F.lit("g"), (F.col("edge_id") % 3).cast("string"))
    return scores.withColumn("g", g).groupBy("country_id").pivot("g", ["g0", "g1", "g2"]).agg(F.round(F.avg("ni"), 4))


@query("sm24_point_cloud", "access", sql="SELECT country_id, 'normal' AS scenario, t_normal AS t FROM access WHERE t_normal IS NOT NULL UNION ALL SELECT country_id, 'extreme', t_extreme FROM access WHERE t_extreme IS NOT NULL")
def point_cloud(access: DataFrame) -> DataFrame:
    renamed = access.select("country_id", F.col("t_normal").alias("normal"), F.col("t_extreme").alias("extreme"))
    return renamed.unpivot("country_id", ["normal", "extreme"], "scenario", "t").filter("t IS NOT NULL")


@query("sc30_data_audit", "country", "places", "facilities", "pixels", sql="SELECT country, c.country_id IN (SELECT country_id FROM places) AS has_places, c.country_id IN (SELECT country_id FROM facilities) AS has_facilities, c.country_id IN (SELECT country_id FROM pixels) AS has_pixels FROM country c")
def audit(country: DataFrame, places: DataFrame, facilities: DataFrame, pixels: DataFrame) -> DataFrame:
    out = country.select("country_id", "country")
    for name, df in (("has_places", places), ("has_facilities", facilities), ("has_pixels", pixels)):
        seen = df.select("country_id").distinct().withColumn(name, F.lit(True))
        out = out.join(seen, "country_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("country_id")


@query("sc31_window_coverage", "climate", sql="SELECT cell_id, p AS period, bool_or(y BETWEEN p - 1 AND p + 1) AS covered, count(*) FILTER (WHERE y BETWEEN p - 1 AND p + 1) AS n_months FROM (SELECT cell_id, CAST(extract(year FROM month) AS INT) AS y FROM climate) c, (VALUES (1996), (1999), (2005)) x(p) GROUP BY cell_id, p")
def coverage(climate: DataFrame) -> DataFrame:
    rows = climate.select("cell_id", F.year("month").alias("y"), F.explode(F.array(*map(F.lit, (1996, 1999, 2005)))).alias("period"))
    inside = F.col("y").between(F.col("period") - 1, F.col("period") + 1)
    return rows.groupBy("cell_id", "period").agg(F.bool_or(inside).alias("covered"), F.count_if(inside).alias("n_months"))


@query("sk7_interpretation", "scores", sql="SELECT concat('range ', CAST(CAST(round(min(cv) * 1000) AS BIGINT) AS VARCHAR), '-', CAST(CAST(round(max(cv) * 1000) AS BIGINT) AS VARCHAR), ' of ', CAST(count(*) AS VARCHAR)) AS evidence, CASE WHEN max(cv) - min(cv) < 0.1 THEN 'stable' ELSE 'sensitive' END AS verdict FROM scores")
def interpretation(scores: DataFrame) -> DataFrame:
    text = F.format_string("range %d-%d of %d", F.round(F.min("cv") * 1000).cast("bigint"), F.round(F.max("cv") * 1000).cast("bigint"), F.count("*"))
    return scores.agg(text.alias("evidence"), F.when(F.max("cv") - F.min("cv") < 0.1, "stable").otherwise("sensitive").alias("verdict"))


@query("sk8_manifest", "country", sql="SELECT concat('run ', s, ' --country ', country) AS command FROM country, (VALUES ('speed'), ('access'), ('od')) x(s)")
def manifest(country: DataFrame) -> DataFrame:
    steps = F.explode(F.array(*map(F.lit, ("speed", "access", "od"))))
    return country.select("country", steps.alias("s")).select(F.format_string("run %s --country %s", "s", "country").alias("command"))


@query("sm20_case_table", "roads", sql="WITH c AS (SELECT country_id, avg((v_normal - v_extreme) / v_normal * 100) AS d FROM roads GROUP BY country_id) SELECT country_id, round((rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, 5) AS percentile FROM c")
def case_table(roads: DataFrame) -> DataFrame:
    from netaccess.operators.ranking import value_ranks, written

    c = written(roads.groupBy("country_id").agg(F.avg(R.speed_drop_pct(F.col("v_normal"), F.col("v_extreme"))).alias("d")))
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    return value_ranks(c, "d").crossJoin(n).select("country_id", F.round(F.col("avg_rank") / F.col("n") * 100, 5).alias("percentile"))


@query("sm2_recovery_variants", "od", sql="""WITH m AS (SELECT t0, t1 FROM od WHERE t0 > 0 AND t1 >= t0), g AS (SELECT alpha, relief, sum(1 / pow(t1 - (t1 - t0) * relief, alpha)) AS a, sum(1 / pow(t0, alpha)) AS an, sum(1 / pow(t1, alpha)) AS ae FROM m, (VALUES (1.0::DOUBLE), (2.0)) x(alpha), (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) y(relief) GROUP BY alpha, relief)
    SELECT alpha, relief, round((a - ae) / (an - ae), 5) AS recovery FROM g""")
def recovery_variants(od: DataFrame) -> DataFrame:
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(r).alias("relief")) for a in (1.0, 2.0) for r in (0.0, 0.25, 0.5, 1.0)))).alias("g")
    rows = od.filter("t0 > 0 AND t1 >= t0").select("t0", "t1", grid).select("t0", "t1", "g.*")
    total = lambda t: F.sum(1 / F.pow(t, F.col("alpha")))
    a, an, ae = total(F.col("t1") - (F.col("t1") - F.col("t0")) * F.col("relief")), total(F.col("t0")), total(F.col("t1"))
    return rows.groupBy("alpha", "relief").agg(F.round((a - ae) / (an - ae), 5).alias("recovery"))


@query("sm5_nearest_fraction", "scores", sql="WITH r AS (SELECT CAST(row_number() OVER (ORDER BY ni DESC, edge_id) AS DOUBLE) / count(*) OVER () AS f, edge_id FROM scores) SELECT target, arg_min(edge_id, abs(f - target) * 1e9 + edge_id / 1e12) AS edge_id FROM r, (VALUES (0.001::DOUBLE), (0.01), (0.1)) x(target) GROUP BY target")
def nearest_fraction(scores: DataFrame) -> DataFrame:
    from netaccess.operators.ranking import global_rank

    n = F.broadcast(scores.agg(F.count("*").alias("n")))
    ranked = global_rank(scores.select("edge_id", "ni"), [F.desc("ni"), F.asc("edge_id")]).crossJoin(n).withColumn("target", F.explode(F.array(*map(F.lit, (0.001, 0.01, 0.1)))))
    gap = F.abs(F.col("rank") / F.col("n") - F.col("target")) * 1e9 + F.col("edge_id") / 1e12
    return ranked.groupBy("target").agg(F.min_by("edge_id", gap).alias("edge_id"))


@query("sm13_verdict", "scores", sql="WITH a AS (SELECT edge_id FROM scores ORDER BY ni DESC, edge_id LIMIT 25), b AS (SELECT edge_id FROM scores ORDER BY ni * (1 + cv / 10) DESC, edge_id LIMIT 25), j AS (SELECT CAST(count(*) FILTER (WHERE a.edge_id IS NOT NULL AND b.edge_id IS NOT NULL) AS DOUBLE) / count(*) AS j FROM a FULL JOIN b ON a.edge_id = b.edge_id) SELECT round(j, 6) AS jaccard, CASE WHEN round(j, 6) >= 0.8 THEN 'stable' ELSE 'sensitive' END AS verdict FROM j")
def verdict(scores: DataFrame) -> DataFrame:
    a = K.top_k(scores, "ni", "edge_id", 25)
    b = K.top_k(scores.withColumn("s", F.col("ni") * (1 + F.col("cv") / 10)), "s", "edge_id", 25)
    return K.jaccard(a, b, ["edge_id"]).withColumn("verdict", F.when(F.col("jaccard") >= 0.8, "stable").otherwise("sensitive"))


@query("sm15_severity_headline", "od", sql="SELECT f AS factor, round(avg(t1x / t0 - 1) * 100, 5) AS mean_increase FROM (SELECT f, t0, t0 * (1 + (t1 / t0 - 1) * f) AS t1x FROM od, (VALUES (0.8::DOUBLE), (1.0), (1.2)) x(f) WHERE t0 > 0 AND t1 IS NOT NULL) t GROUP BY f")
def severity_headline(od: DataFrame) -> DataFrame:
    rows = od.filter("t0 > 0 AND t1 IS NOT NULL").withColumn("factor", F.explode(F.array(*map(F.lit, (0.8, 1.0, 1.2)))))
    scaled = F.col("t0") * (1 + (F.col("t1") / F.col("t0") - 1) * F.col("factor"))
    return rows.groupBy("factor").agg(F.round(F.avg(scaled / F.col("t0") - 1) * 100, 5).alias("mean_increase"))


@query("sm21_leverage", "scores", sql="WITH r AS (SELECT ni * cv AS s, row_number() OVER (ORDER BY ni * cv DESC, edge_id) AS r, count(*) OVER () AS n FROM scores WHERE cv > 0.02) SELECT max(n) AS n_unpaved, round(sum(CASE WHEN r <= floor(n * 0.01) THEN s ELSE 0 END) / sum(s) * 100, 5) AS guided_pct, round(sum(CASE WHEN r <= floor(n * 0.01) THEN s ELSE 0 END) / sum(s) / (floor(max(n) * 0.01) / max(n)), 4) AS leverage FROM r")
def leverage(scores: DataFrame) -> DataFrame:
    """What the first hundredth of the slowed edges holds of the total score, against an even share."""
    pool = scores.filter("cv > 0.02").withColumn("s", F.col("ni") * F.col("cv"))
    n = pool.count()
    k = n // 100
    top = pool.orderBy(F.desc("s"), "edge_id").limit(k).agg(F.sum("s").alias("top"))
    share = F.col("top") / F.col("total")
    return pool.agg(F.count("*").alias("n_unpaved"), F.sum("s").alias("total")).crossJoin(F.broadcast(top)).select("n_unpaved", F.round(share * 100, 5).alias("guided_pct"), F.round(share / (k / n), 4).alias("leverage"))


@query("sm23_mirror_table", "access", "country", sql="WITH a AS (SELECT country_id, quantile_cont(t_extreme - t_normal, 0.5) AS p50, quantile_cont(t_extreme - t_normal, 0.9) AS p90 FROM access GROUP BY country_id) SELECT country, round(p50 * 60, 4) AS p50_min, round(p90 * 60, 4) AS p90_min, round((p90 - p50) * 60, 4) AS gap_min, p90 > 1 AS capped FROM a JOIN country c ON a.country_id = c.country_id")
def mirror(access: DataFrame, country: DataFrame) -> DataFrame:
    d = F.col("t_extreme") - F.col("t_normal")
    a = access.groupBy("country_id").agg(F.percentile(d, 0.5).alias("p50"), F.percentile(d, 0.9).alias("p90"))
    minutes = lambda c, k: F.round(c * 60, 4).alias(k)
    return a.join(country, "country_id").select("country", minutes(F.col("p50"), "p50_min"), minutes(F.col("p90"), "p90_min"), minutes(F.col("p90") - F.col("p50"), "gap_min"), (F.col("p90") > 1).alias("capped"))
