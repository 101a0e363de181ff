"""Queries of scalar functions over text, numbers, dates and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.functions import rules as R
from netaccess.plans.registry import query


@query("fs1_normal_name", "customer", sql="SELECT c_custkey, trim(regexp_replace(replace(replace(lower(concat(c_name, '''s-', c_mktsegment)), '''', ''), '-', ' '), '\\s+', ' ', 'g')) AS name FROM customer")
def normal_name(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", R.normal_name(F.concat("c_name", F.lit("'s-"), "c_mktsegment")).alias("name"))


@query("fs2_camel_split", "part", sql="SELECT p_partkey, regexp_replace(regexp_replace(p_type, '([A-Z])', ' \\1', 'g'), '^ ', '') AS label FROM part")
def camel(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.regexp_replace("p_type", "(?<!^)(?=[A-Z])", " ").alias("label"))


@query("fs3_safe_id", "customer", sql="SELECT c_custkey, translate(concat(c_name, '.a-b'), '.-', '__') AS id FROM customer")
def safe_id(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", F.translate(F.concat("c_name", F.lit(".a-b")), ".-", "__").alias("id"))


@query("fs4_extract_int", "supplier", sql="SELECT s_suppkey, TRY_CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) AS n FROM supplier")
def extract_int(supplier: DataFrame) -> DataFrame:
    return supplier.select("s_suppkey", F.regexp_extract("s_name", "([0-9]+)", 1).try_cast("bigint").alias("n"))


@query("fs5_synthesised_id", "places", sql="SELECT place_id, concat('C', CAST(country_id AS VARCHAR), '_', lpad(CAST(row_number() OVER (PARTITION BY country_id ORDER BY place_id) AS VARCHAR), 4, '0')) AS id FROM places")
def synthesised(places: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("country_id").orderBy("place_id"))
    return places.select("place_id", F.concat(F.lit("C"), F.col("country_id").cast("string"), F.lit("_"), F.lpad(n.cast("string"), 4, "0")).alias("id"))


@query("fs6_threshold_label", "access", sql="SELECT node_id, CASE WHEN t_normal < 1 THEN concat(CAST(CAST(floor(t_normal * 60) AS BIGINT) AS VARCHAR), ' min') ELSE concat(CAST(CAST(floor(t_normal) AS BIGINT) AS VARCHAR), ' h') END AS label FROM access WHERE t_normal IS NOT NULL")
def threshold_label(access: DataFrame) -> DataFrame:
    t = F.col("t_normal")
    label = F.when(t < 1, F.format_string("%d min", F.floor(t * 60))).otherwise(F.format_string("%d h", F.floor(t)))
    return access.filter(t.isNotNull()).select("node_id", label.alias("label"))


@query("fs7_degree_label", "pixels", sql="SELECT pixel_id, CASE WHEN lat - 10 = 0 THEN '0°' WHEN lat > 10 THEN concat(CAST(CAST(trunc(abs(lat - 10)) AS INT) AS VARCHAR), '°N') ELSE concat(CAST(CAST(trunc(abs(lat - 10)) AS INT) AS VARCHAR), '°S') END AS label FROM pixels")
def degree_label(pixels: DataFrame) -> DataFrame:
    return pixels.select("pixel_id", R.degree_label(F.col("lat") - 10, "N", "S").alias("label"))


@query("fs8_stars", "lineitem", sql="SELECT CASE WHEN l_discount / 2 < 0.001 THEN '***' WHEN l_discount / 2 < 0.01 THEN '**' WHEN l_discount / 2 < 0.05 THEN '*' ELSE '' END AS stars, count(*) AS n FROM lineitem GROUP BY 1")
def stars(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(R.stars(F.col("l_discount") / 2).alias("stars")).agg(F.count("*").alias("n"))


@query("fs9_split_list", "part", sql="SELECT word, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS word FROM part) t GROUP BY word")
def split_list(part: DataFrame) -> DataFrame:
    return part.select(F.explode(F.split("p_name", " ")).alias("word")).select(F.trim("word").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("fs10_md5_sign", "customer", sql="SELECT c_custkey, CASE WHEN right(md5(c_name), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END AS sign FROM customer")
def md5_sign(customer: DataFrame) -> DataFrame:
    digit = F.conv(F.right(F.md5(F.col("c_name").cast("binary")), F.lit(1)), 16, 10).cast("int")
    return customer.select("c_custkey", F.when(digit % 2 == 0, 1).otherwise(-1).alias("sign"))


@query("fd1_dates", "orders", sql="SELECT CAST(extract(year FROM o_orderdate) AS INT) AS year, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders WHERE extract(year FROM o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1, 2")
def dates(orders: DataFrame) -> DataFrame:
    kept = orders.filter(F.year("o_orderdate").between(1996, 1998))
    return kept.groupBy(F.year("o_orderdate").alias("year"), F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"))


@query("fm2_interpolate", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN x <= 6 THEN 106 " + " ".join(f"WHEN x <= {b[0]} THEN {a[1]} + (x - {a[0]}) * ({b[1] - a[1]} / {b[0] - a[0]})" for a, b in zip(C.ROUGHNESS_SPEED, C.ROUGHNESS_SPEED[1:])) + " ELSE 32 END, 6) AS speed FROM (SELECT *, least(greatest(l_quantity / 2.0, 6.0), 20.0) AS x FROM lineitem) t")
def interpolate(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(R.roughness_speed(F.col("l_quantity") / 2), 6).alias("speed"))


@query("fm3_math", "roads", sql="SELECT road_id, round(tan(radians(lat)) * 100, 4) AS slope, round(ln(1 + length_km), 6) AS l1p, round(sqrt(lon * lon + lat * lat), 6) AS h, round(asinh(length_km), 6) AS a, round(cos(radians(lat)) * pow(length_km, 0.5), 6) AS c FROM roads")
def math(roads: DataFrame) -> DataFrame:
    return roads.select("road_id", F.round(F.tan(F.radians("lat")) * 100, 4).alias("slope"), F.round(F.log1p("length_km"), 6).alias("l1p"), F.round(F.hypot("lon", "lat"), 6).alias("h"), F.round(F.asinh("length_km"), 6).alias("a"), F.round(F.cos(F.radians("lat")) * F.pow("length_km", F.lit(0.5)), 6).alias("c"))


@query("fm4_positive_max", "scores", sql="SELECT edge_id, round(CASE WHEN cv > 0.02 THEN cv ELSE 0 END / nullif((SELECT max(cv) FROM scores WHERE cv > 0.02), 0), 6) AS cv_n FROM scores")
def positive_max(scores: DataFrame) -> DataFrame:
    most = F.broadcast(scores.filter(F.col("cv") > C.CV_MIN).agg(F.max("cv").alias("most")))
    return scores.crossJoin(most).select("edge_id", F.round(F.try_divide(F.when(F.col("cv") > C.CV_MIN, F.col("cv")).otherwise(0.0), "most"), 6).alias("cv_n"))


@query("fm5_half_even", "lineitem", sql="SELECT DISTINCT l_quantity, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS r FROM lineitem")
def half_even(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_quantity", F.bround(F.col("l_quantity") / 4).cast("bigint").alias("r")).distinct()


@query("fm6_size_scale", "country", "roads", sql="WITH c AS (SELECT country_id, count(*) AS n FROM roads GROUP BY country_id), m AS (SELECT sqrt(min(n)) AS a, sqrt(max(n)) AS b FROM c) SELECT country_id, round(20 + 100 * coalesce((sqrt(n) - a) / nullif(b - a, 0), 0), 5) AS size FROM c, m")
def size_scale(country: DataFrame, roads: DataFrame) -> DataFrame:
    c = roads.groupBy("country_id").agg(F.count("*").alias("n"))
    m = F.broadcast(c.agg(F.sqrt(F.min("n")).alias("a"), F.sqrt(F.max("n")).alias("b")))
    return c.crossJoin(m).select("country_id", F.round(20 + 100 * F.coalesce(F.try_divide(F.sqrt("n") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)), 5).alias("size"))


@query("fm7_minutes", "access", sql="SELECT node_id, round(CASE WHEN t_normal <= 4 THEN t_normal * 60 ELSE t_normal END, 6) AS minutes FROM access")
def minutes(access: DataFrame) -> DataFrame:
    return access.select("node_id", F.round(F.when(F.col("t_normal") <= 4, F.col("t_normal") * 60).otherwise(F.col("t_normal")), 6).alias("minutes"))


@query("fp1_map_default", "events", sql="SELECT coalesce(CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' END, 'other') AS kind, count(*) AS n FROM events GROUP BY 1")
def map_default(events: DataFrame) -> DataFrame:
    names = F.create_map(F.lit("click"), F.lit("c"), F.lit("view"), F.lit("v"))
    return events.groupBy(F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


@query("fj1_json", "country", sql="SELECT country_id, concat('{\"country\":\"', country, '\",\"region_id\":', CAST(region_id AS VARCHAR), '}') AS j FROM country")
def to_json(country: DataFrame) -> DataFrame:
    return country.select("country_id", F.to_json(F.struct("country", "region_id")).alias("j"))


@query("sc26_tag_strip", "pages", sql="SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS n, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def tag_strip(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("bigint").alias("n"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("fm1_clip", "lineitem", sql="SELECT l_linenumber, round(sum(least(greatest(l_discount * 20 - 0.5, 0), 1)), 4) AS s FROM lineitem GROUP BY l_linenumber")
def clip(lineitem: DataFrame) -> DataFrame:
    x = F.least(F.greatest(F.col("l_discount") * 20 - 0.5, F.lit(0.0)), F.lit(1.0))
    return lineitem.groupBy("l_linenumber").agg(F.round(F.sum(x), 4).alias("s"))


@query("fa1_block_sums", "pixels", sql="SELECT CAST(floor(y / 100) AS BIGINT) AS r, CAST(floor(x / 100) AS BIGINT) AS c, round(sum(pop), 3) AS pop, count(*) AS n FROM pixels GROUP BY 1, 2")
def block_sums(pixels: DataFrame) -> DataFrame:
    """A raster summed over blocks: the relational form of a reshape and sum."""
    return pixels.groupBy(F.floor(F.col("y") / 100).alias("r"), F.floor(F.col("x") / 100).alias("c")).agg(F.round(F.sum("pop"), 3).alias("pop"), F.count("*").alias("n"))


@query("sc15_positive_pixels", "pixels", sql="SELECT CAST(count(*) AS BIGINT) AS n, round(sum(pop), 3) AS pop, round(min(lon), 4) AS lon FROM (SELECT floor(y / 10) AS r, floor(x / 10) AS c, sum(pop) AS pop, 10 + (floor(x / 10) + 0.5) * 0.1 AS lon FROM pixels GROUP BY 1, 2, 4) t WHERE pop > 0")
def positive_pixels(pixels: DataFrame) -> DataFrame:
    from netaccess.sources.tables import positive_pixels as scan

    raster = pixels.select(F.col("y").alias("row"), F.col("x").alias("col"), "pop")
    return scan(raster, -99.0, 10.0, 50.0, 0.01, block=10).agg(F.count("*").alias("n"), F.round(F.sum("pop"), 3).alias("pop"), F.round(F.min("lon"), 4).alias("lon"))


@query("sc17_facility_scan", "facilities", sql="SELECT facility_id, lon, lat FROM facilities WHERE lon IS NOT NULL AND lat IS NOT NULL")
def facility_scan(facilities: DataFrame) -> DataFrame:
    return facilities.na.drop(subset=["lon", "lat"]).select("facility_id", "lon", "lat")


@query("sc18_search_text", "facilities", sql="SELECT facility_id, concat(lower(coalesce(amenity, '')), ' ', lower(coalesce(name, ''))) AS text FROM facilities")
def search_text(facilities: DataFrame) -> DataFrame:
    return facilities.select("facility_id", F.concat_ws(" ", F.lower(F.coalesce("amenity", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))).alias("text"))


@query("sc22_not_null_projection", "access", sql="SELECT node_id, lon, lat, t_extreme FROM access WHERE t_extreme IS NOT NULL")
def not_null(access: DataFrame) -> DataFrame:
    return access.filter("t_extreme IS NOT NULL").select("node_id", "lon", "lat", "t_extreme")


@query("sc21_bbox_overlap", "roads", sql="SELECT road_id FROM roads WHERE least(lon, lat) <= 8 AND greatest(lon, lat) >= 6 AND v_extreme IS NOT NULL")
def bbox(roads: DataFrame) -> DataFrame:
    """Rows whose extent meets a tile: a range predicate on the extent's columns."""
    return roads.filter((F.least("lon", "lat") <= 8) & (F.greatest("lon", "lat") >= 6) & F.col("v_extreme").isNotNull()).select("road_id")
