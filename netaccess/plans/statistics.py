"""Queries of statistics: rank correlation, regressions, percentiles and clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators import statistics as T
from netaccess.operators.ranking import quantiles
from netaccess.plans.registry import query

RANKED = """WITH r AS (SELECT rank() OVER (ORDER BY t_normal) + (count(*) OVER (PARTITION BY t_normal) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY population) + (count(*) OVER (PARTITION BY population) - 1) / 2.0::DOUBLE AS b FROM access WHERE t_normal IS NOT NULL AND population IS NOT NULL)"""


@query("sta_spearman", "access", sql=f"{RANKED} SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(access: DataFrame) -> DataFrame:
    return T.spearman(access, "t_normal", "population").select(F.round("rho", 6).alias("rho"), "n")


@query("stb_spearman_p", "access", "country")
def spearman_p(access: DataFrame, country: DataFrame) -> DataFrame:
    """rho with its two-sided p-value and stars, over the countries' means."""
    from netaccess.functions.rules import stars

    means = access.groupBy("country_id").agg(F.avg("t_normal").alias("t"), F.avg("population").alias("p"))
    row = T.spearman(means, "t", "p").first()
    rho, n = row["rho"] or 0.0, row["n"]
    p = T.t_p_value(rho * math.sqrt(max(0, n - 2) / max(1e-300, 1 - rho * rho)), n - 2)
    return country.agg(F.lit(round(rho, 6)).alias("rho"), F.lit(round(p, 6)).alias("p"), F.lit(n).cast("bigint").alias("n")).withColumn("stars", stars(F.col("p")))


@query("stc_least_squares", "access", sql="""WITH g AS (SELECT t_extreme - t_normal AS y, ln(1 + population) AS x FROM access WHERE t_extreme IS NOT NULL)
    SELECT round(regr_intercept(y, x), 6) AS b0, round(regr_slope(y, x), 6) AS b1, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM g""")
def ols(access: DataFrame) -> DataFrame:
    rows = access.filter("t_extreme IS NOT NULL").select((F.col("t_extreme") - F.col("t_normal")).alias("y"), F.log1p("population").alias("x"))
    m = T.least_squares(rows, ["x"], "y")
    return access.agg(F.lit(round(m["beta"][0], 6)).alias("b0"), F.lit(round(m["beta"][1], 6)).alias("b1"), F.lit(round(m["r2"], 6)).alias("r2"), F.lit(m["n"]).cast("bigint").alias("n"))


@query("ste_regression_line", "access", sql="SELECT country_id, round(regr_slope(t_extreme, t_normal), 5) AS slope, round(regr_intercept(t_extreme, t_normal), 5) AS intercept FROM access GROUP BY country_id HAVING count(t_extreme) > 5")
def line(access: DataFrame) -> DataFrame:
    rows = access.groupBy("country_id").agg(F.round(F.regr_slope("t_extreme", "t_normal"), 5).alias("slope"), F.round(F.regr_intercept("t_extreme", "t_normal"), 5).alias("intercept"), F.count("t_extreme").alias("n"))
    return rows.filter("n > 5").drop("n")


@query("stf_weighted_line", "access", sql="""WITH c AS (SELECT country_id, avg(t_normal) AS x, avg(t_extreme) AS y, CAST(count(*) AS DOUBLE) AS w FROM access GROUP BY country_id), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM c)
    SELECT round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 5) AS slope, round(max(my) - sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) * max(mx), 5) AS intercept FROM c, m""")
def weighted_line(access: DataFrame) -> DataFrame:
    """Residuals weighted by sqrt(n), so squares by n."""
    c = access.groupBy("country_id").agg(F.avg("t_normal").alias("x"), F.avg("t_extreme").alias("y"), F.count("*").cast("double").alias("w"))
    m = F.broadcast(c.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my")))
    dx, dy, w = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("w")
    slope = F.sum(w * dx * dy) / F.sum(w * dx * dx)
    return c.crossJoin(m).agg(F.round(slope, 5).alias("slope"), F.round(F.max("my") - slope * F.max("mx"), 5).alias("intercept"))


@query("sti_percentiles", "od", sql="SELECT " + ", ".join(f"round(quantile_cont(t0, {q}), 6) AS p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM od")
def percentiles(od: DataFrame) -> DataFrame:
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    return quantiles(od, {"p": (F.col("t0"), shares)}).select(*(F.round(f"p_{i}", 6).alias(f"p{int(q * 100)}") for i, q in enumerate(shares)))


def plane_sql(keys: str) -> str:
    """The closed form of a fit on two predictors, over rows p (keys, x, z, y)."""
    return f"""s AS (SELECT {keys}, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, var_pop(y) AS yy, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, var_pop(x) * var_pop(z) - covar_pop(x, z) * covar_pop(x, z) AS det FROM p WHERE x IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL GROUP BY {keys}),
    b AS (SELECT *, (zz * xy - xz * zy) / det AS b1, (xx * zy - xz * xy) / det AS b2 FROM s WHERE n >= 4 AND det > 1e-12 * xx * zz), f AS (SELECT *, my - b1 * mx - b2 * mz AS b0, greatest(yy - b1 * xy - b2 * zy, 0) / (n - 3) AS s2, (b1 * xy + b2 * zy) / yy AS r2 FROM b)"""


SLOWED = "access JOIN country ON access.country_id = country.country_id"


def slowed(access: DataFrame, country: DataFrame) -> DataFrame:
    """region, x, z, y: log population, time and delay of every place of access."""
    return access.join(country.select("country_id", "region"), "country_id").select("region", F.log1p("population").alias("x"), F.col("t_normal").alias("z"), (F.col("t_extreme") - F.col("t_normal")).alias("y"))


@query("stc_two_predictors", "access", "country", sql=f"""WITH p AS (SELECT region, ln(1 + population) AS x, t_normal AS z, t_extreme - t_normal AS y FROM {SLOWED}), {plane_sql("region")}
    SELECT region, n, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(sqrt(s2 * (1 + (mx * mx * zz - 2 * mx * mz * xz + mz * mz * xx) / det)), 6) AS se0, round(sqrt(s2 * zz / det), 6) AS se1, round(sqrt(s2 * xx / det), 6) AS se2, round(b2 / sqrt(s2 * xx / det), 4) AS t2, round(r2, 6) AS r2 FROM f""")
def two_predictors(access: DataFrame, country: DataFrame) -> DataFrame:
    """The delay by population and time in every region: coefficients with standard errors."""
    fits = T.plane_fits(slowed(access, country), ["region"], "x", "z", "y")
    return fits.select("region", "n", *(F.round(c, 6).alias(c) for c in ("b0", "b1", "b2", "se0", "se1", "se2")), F.round("t2", 4).alias("t2"), F.round("r2", 6).alias("r2"))


@query("stc_significance", "access", "country")
def significance(access: DataFrame, country: DataFrame) -> DataFrame:
    """A row for each region and term: coefficient, standard error, p and stars."""
    from netaccess.functions.rules import stars

    terms = F.explode(F.array(*(F.struct(F.lit(name).alias("term"), F.col(f"b{k}").alias("b"), F.col(f"se{k}").alias("se"), F.col(f"t{k}").alias("t")) for k, name in enumerate(("const", "log_population", "t_normal"))))).alias("e")
    long = T.plane_fits(slowed(access, country), ["region"], "x", "z", "y").select("region", "n", "r2", terms).select("region", "n", "r2", "e.*")
    long = long.withColumn("p", T.two_sided_p("t", (F.col("n") - 3).cast("double")))
    return long.select("region", "term", "n", F.round("b", 6).alias("coefficient"), F.round("se", 6).alias("standard_error"), F.round("p", 6).alias("p"), stars(F.col("p")).alias("stars"), F.round("r2", 6).alias("r2"))


#: Coefficients that candidates are compared with: constant, first and second predictor, r2.
PUBLISHED = (0.2, 0.01, 0.1, 0.3)
FORMS = {"log1p": ("ln(1 + {c})", "{c} IS NOT NULL"), "log": ("ln({c})", "{c} > 0"), "identity": ("CAST({c} AS DOUBLE)", "{c} IS NOT NULL")}


def candidates_sql(table: str) -> str:
    """Rows of every candidate: a transform for each of two predictors; rows that a transform does not take leave that candidate alone."""
    parts = [
        f"SELECT '{f}' AS x_form, '{zc}' AS z_field, '{g}' AS z_form, CASE WHEN {FORMS[f][1].format(c='population')} THEN {FORMS[f][0].format(c='population')} END AS x, CASE WHEN {FORMS[g][1].format(c=zc)} THEN {FORMS[g][0].format(c=zc)} END AS z, t_extreme - t_normal AS y FROM {table}"
        for f in ("log1p", "log") for zc in ("t_normal", "lon") for g in ("log", "log1p", "identity")
    ]
    return " UNION ALL ".join(parts)


DISTANCE = " + ".join(f"abs({c} - CAST({x} AS DOUBLE))" for c, x in zip(("b0", "b1", "b2", "r2"), PUBLISHED))


@query("std_model_grid", "access", sql=f"""WITH p AS ({candidates_sql('access')}), {plane_sql("x_form, z_field, z_form")}, d AS (SELECT *, {DISTANCE} AS distance FROM f) SELECT x_form, z_field, z_form, n, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(r2, 6) AS r2, round(distance, 6) AS distance, row_number() OVER (ORDER BY round(distance, 9), x_form, z_field, z_form) AS place FROM d""")
def model_grid(access: DataFrame) -> DataFrame:
    """Every candidate of transforms and predictors, solved together, by its distance from given coefficients."""
    rows = access.sparkSession.sql(candidates_sql("{t}"), t=access)
    fits = T.plane_fits(rows, ["x_form", "z_field", "z_form"], "x", "z", "y").withColumn("distance", F.expr(DISTANCE))
    place = F.row_number().over(Window.orderBy(F.round("distance", 9), "x_form", "z_field", "z_form"))  # a row for each candidate
    return fits.select("x_form", "z_field", "z_form", "n", *(F.round(c, 6).alias(c) for c in ("b0", "b1", "b2", "r2", "distance")), place.cast("bigint").alias("place"))


@query("stg_kmeans", "embeddings")
def kmeans(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster: labels from all dimensions, standardised; the cheapest of ten starts, clusters numbered by falling size."""
    dims = embeddings.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0
    rows = embeddings.filter(F.size("embedding") == dims)
    k = min(5, max(2, rows.count() // 20))
    return T.clusters(T.standardised(rows.select("vec_id", "embedding"), "embedding", dims), "vec_id", "embedding", k)[0]


@query("sth_cluster_tags", "scores", sql="SELECT country_id, CASE WHEN avg(cv) > 0.045 AND avg(ni) > (SELECT avg(ni) FROM scores) THEN 'critical' WHEN avg(cv) > 0.045 THEN 'vulnerable' WHEN avg(ni) > (SELECT avg(ni) FROM scores) THEN 'important' ELSE 'stable' END AS tag FROM scores GROUP BY country_id")
def tags(scores: DataFrame) -> DataFrame:
    overall = F.broadcast(scores.agg(F.avg("ni").alias("all_ni")))
    c = scores.groupBy("country_id").agg(F.avg("cv").alias("c"), F.avg("ni").alias("n")).crossJoin(overall)
    high_c, high_n = F.col("c") > 0.045, F.col("n") > F.col("all_ni")
    return c.select("country_id", F.when(high_c & high_n, "critical").when(high_c, "vulnerable").when(high_n, "important").otherwise("stable").alias("tag"))


@query("stj_predicted_surface", "access", sql="SELECT country_id, round(0.778 - 0.038 * ln(1 + avg(t_normal)) - 0.044 * ln(1 + avg(population)), 5) AS predicted FROM access GROUP BY country_id")
def surface(access: DataFrame) -> DataFrame:
    return access.groupBy("country_id").agg(F.round(0.778 - 0.038 * F.log1p(F.avg("t_normal")) - 0.044 * F.log1p(F.avg("population")), 5).alias("predicted"))


@query("std_model_search", "access", sql="""WITH g AS (SELECT t_extreme - t_normal AS y, population AS p, t_normal AS t FROM access WHERE t_extreme IS NOT NULL), m AS (SELECT 'identity' AS form, regr_r2(y, p) AS r2 FROM g UNION ALL SELECT 'log1p', regr_r2(y, ln(1 + p)) FROM g UNION ALL SELECT 'sqrt', regr_r2(y, sqrt(p)) FROM g UNION ALL SELECT 'time', regr_r2(y, t) FROM g) SELECT form, round(r2, 6) AS r2 FROM m""")
def model_search(access: DataFrame) -> DataFrame:
    """Every candidate predictor from one aggregation of the same rows."""
    rows = access.filter("t_extreme IS NOT NULL").withColumn("y", F.col("t_extreme") - F.col("t_normal"))
    forms = {"identity": F.col("population"), "log1p": F.log1p("population"), "sqrt": F.sqrt("population"), "time": F.col("t_normal")}
    wide = rows.agg(*(F.regr_r2("y", x).alias(k) for k, x in forms.items()))
    return wide.unpivot([], list(forms), "form", "r2").select("form", F.round("r2", 6).alias("r2"))
