"""Queries of spatial joins. Integer coordinates (x, y) keep distances and ties exact in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.operators import spatial as S
from netaccess.plans.registry import query

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query("sp1_grid_index", "pixels", sql="SELECT pixel_id, CAST(floor(lon / 0.44) AS BIGINT) * 1000 + CAST(floor(lat / 0.44) AS BIGINT) AS cell FROM pixels")
def grid_index(pixels: DataFrame) -> DataFrame:
    return pixels.select("pixel_id", (F.floor(F.col("lon") / 0.44) * 1000 + F.floor(F.col("lat") / 0.44)).alias("cell"))


def nearest_sql(a: str, a_id: str, b: str, b_id: str, limit: int) -> str:
    return f"SELECT {a_id}, {b_id}, CAST(d2 AS DOUBLE) AS d2 FROM (SELECT a.{a_id}, b.{b_id}, {D2} AS d2, row_number() OVER (PARTITION BY a.{a_id} ORDER BY {D2}, b.{b_id}) AS r FROM {a} a JOIN {b} b ON {D2} <= {limit * limit}) t WHERE r = 1"


@query("sp2_nearest_place", "pixels", "places", sql=nearest_sql("pixels", "pixel_id", "places", "place_id", 80))
def nearest_place(pixels: DataFrame, places: DataFrame) -> DataFrame:
    return S.nearest(pixels, "pixel_id", places, "place_id", "x", "y", 80.0, 40.0)


@query("sp3_catchment", "pixels", "places", sql=f"SELECT p.place_id, round(coalesce(s, 0), 2) AS population FROM places p LEFT JOIN (SELECT place_id, sum(pop) AS s FROM ({nearest_sql('pixels', 'pixel_id', 'places', 'place_id', 80)}) n JOIN pixels USING (pixel_id) GROUP BY place_id) c ON p.place_id = c.place_id")
def catchment(pixels: DataFrame, places: DataFrame) -> DataFrame:
    own = S.nearest(pixels, "pixel_id", places, "place_id", "x", "y", 80.0, 40.0).join(pixels, "pixel_id").groupBy("place_id").agg(F.sum("pop").alias("s"))
    return places.join(own, "place_id", "left").select("place_id", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("population"))


@query("sp4_match_within", "places", "pixels", sql=f"SELECT p.place_id, coalesce(pixel_id, -1) AS pixel_id FROM places p LEFT JOIN ({nearest_sql('places', 'place_id', 'pixels', 'pixel_id', 10)}) n ON p.place_id = n.place_id")
def match_within(places: DataFrame, pixels: DataFrame) -> DataFrame:
    found = S.nearest(places, "place_id", pixels, "pixel_id", "x", "y", 10.0)
    return places.join(found, "place_id", "left").select("place_id", F.coalesce("pixel_id", F.lit(-1).cast("bigint")).alias("pixel_id"))


@query("sp5_eps_pairs", "pixels", sql=f"SELECT a.pixel_id AS i, b.pixel_id AS j FROM pixels a JOIN pixels b ON a.pixel_id < b.pixel_id AND {D2} <= 64")
def eps_pairs(pixels: DataFrame) -> DataFrame:
    p = pixels.select("pixel_id", "x", "y")
    return S.within(p, p, "x", "y", 8.0).filter("l.pixel_id < r.pixel_id").select(F.col("l.pixel_id").alias("i"), F.col("r.pixel_id").alias("j"))


@query("sp6_cross_border_pairs", "pixels", sql=f"SELECT a.pixel_id AS i, b.pixel_id AS j FROM pixels a JOIN pixels b ON a.pixel_id < b.pixel_id AND a.country_id <> b.country_id AND {D2} <= 64")
def border_pairs(pixels: DataFrame) -> DataFrame:
    p = pixels.select("pixel_id", "country_id", "x", "y")
    near = S.within(p, p, "x", "y", 8.0).filter("l.pixel_id < r.pixel_id AND l.country_id <> r.country_id")
    return near.select(F.col("l.pixel_id").alias("i"), F.col("r.pixel_id").alias("j"))


@query("sp7_border_band", "pixels", sql="WITH b AS (SELECT country_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pixels GROUP BY country_id) SELECT pixel_id FROM pixels p JOIN b ON p.country_id = b.country_id WHERE x - x0 <= 25 OR x1 - x <= 25 OR y - y0 <= 25 OR y1 - y <= 25")
def border_band(pixels: DataFrame, band: int = 25) -> DataFrame:
    box = pixels.groupBy("country_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return pixels.join(box, "country_id").filter(f"x - x0 <= {band} OR x1 - x <= {band} OR y - y0 <= {band} OR y1 - y <= {band}").select("pixel_id")


RECT = "x >= 10 * r_id AND x < 10 * r_id + 200 AND y >= 150 * r_id AND y < 150 * r_id + 300"


@query("sp8_point_in_polygon", "pixels", "region", sql=f"SELECT pixel_id, min(CASE WHEN {RECT} THEN r_id END) AS polygon_id FROM pixels, (SELECT CAST(r_regionkey AS BIGINT) AS r_id FROM region) g GROUP BY pixel_id")
def in_polygon(pixels: DataFrame, region: DataFrame) -> DataFrame:
    """One rectangle for each region; the points lie on the integer grid, the sides half a step before it."""
    k = F.col("r_regionkey").cast("bigint")
    corner = lambda dx, dy: F.struct((10 * k + dx - 0.5).alias("x"), (150 * k + dy - 0.5).alias("y"))
    rings = region.select(k.alias("polygon_id"), F.array(corner(0, 0), corner(200, 0), corner(200, 300), corner(0, 300), corner(0, 0)).alias("ring"))
    points = pixels.select("pixel_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return S.first_polygon(points, rings, "x", "y", 100.0).select("pixel_id", "polygon_id")


@query("sp10_cell_centre", "pixels", sql="SELECT pixel_id, floor(lon * 2) / 2 + 0.25 AS cell_lon, floor(lat * 2) / 2 + 0.25 AS cell_lat FROM pixels")
def cell_centre(pixels: DataFrame) -> DataFrame:
    mid = lambda c: (F.floor(F.col(c) * 2) / 2 + 0.25).alias(f"cell_{c}")
    return pixels.select("pixel_id", mid("lon"), mid("lat"))


@query("sp11_cell_area", "pixels", sql="SELECT pixel_id, round(pow(0.5 * 111, 2) * cos(radians(lat)), 5) AS area FROM pixels")
def cell_area(pixels: DataFrame) -> DataFrame:
    return pixels.select("pixel_id", F.round(S.cell_area_km2(F.col("lat"), C.POP_CELL_DEG, C.KM_PER_DEG), 5).alias("area"))


@query("sp13_knn_midpoints", "places", sql=f"SELECT DISTINCT round((ax + bx) / 2.0, 5) AS mx, round((ay + b_y) / 2.0, 5) AS my FROM (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, row_number() OVER (PARTITION BY a.place_id ORDER BY {D2}, b.place_id) AS r FROM places a JOIN places b ON a.place_id <> b.place_id) t WHERE r <= 4")
def knn(places: DataFrame, k: int = 4) -> DataFrame:
    """Middles between every place and its four nearest, however far."""
    near = S.k_nearest(places, "place_id", places, "place_id", "x", "y", k, itself=False)
    at = lambda i, n: places.select(F.col("place_id").alias(i), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    pairs = near.join(at("place_id", "a"), "place_id").join(at("neighbour", "b"), "neighbour")
    return pairs.select(F.round((F.col("ax") + F.col("bx")) / 2, 5).alias("mx"), F.round((F.col("ay") + F.col("by")) / 2, 5).alias("my")).distinct()


@query("sp1_irregular_axes", "pixels", "facilities", sql="""WITH ax AS (SELECT DISTINCT x FROM facilities), ay AS (SELECT DISTINCT y FROM facilities), px AS (SELECT DISTINCT x FROM pixels), py AS (SELECT DISTINCT y FROM pixels),
    nx AS (SELECT px.x, arg_min(ax.x, abs(px.x - ax.x) * 100000 + ax.x) AS cx FROM px, ax GROUP BY px.x), ny AS (SELECT py.y, arg_min(ay.y, abs(py.y - ay.y) * 100000 + ay.y) AS cy FROM py, ay GROUP BY py.y)
    SELECT pixel_id, CAST(cx AS DOUBLE) AS cell_x, CAST(cy AS DOUBLE) AS cell_y FROM pixels JOIN nx ON pixels.x = nx.x JOIN ny ON pixels.y = ny.y""")
def irregular(pixels: DataFrame, facilities: DataFrame) -> DataFrame:
    """The cell of a grid with unequal steps, whose axes are the facilities' coordinates, nearest to each pixel."""
    out = pixels.select("pixel_id", "x", "y")
    for axis in ("x", "y"):
        out = S.nearest_on_axis(out, axis, facilities, axis, f"cell_{axis}")
    return out.select("pixel_id", "cell_x", "cell_y")


ROAD_BOX = "SELECT road_id, (u * 53) % 1000 AS x0, (u * 53) % 1000 + CAST(length_km AS BIGINT) AS x1, (v * 91) % 1000 AS y0, (v * 91) % 1000 + CAST(length_km AS BIGINT) % 17 AS y1 FROM roads"
PLACE_BOX = "SELECT place_id, x - pop_max % 40 AS x0, x + pop_max % 60 AS x1, y - pop_max % 30 AS y0, y + pop_max % 50 AS y1 FROM places"


@query("sc21_box_join", "roads", "places", sql=f"SELECT place_id, count(*) AS n_roads, min(road_id) AS first_road FROM ({ROAD_BOX}) r JOIN ({PLACE_BOX}) p ON r.x0 <= p.x1 AND p.x0 <= r.x1 AND r.y0 <= p.y1 AND p.y0 <= r.y1 GROUP BY place_id")
def box_join(roads: DataFrame, places: DataFrame) -> DataFrame:
    """Roads whose extent meets the extent of a place."""
    spark = roads.sparkSession
    r, p = spark.sql(ROAD_BOX.replace("FROM roads", "FROM {roads}"), roads=roads), spark.sql(PLACE_BOX.replace("FROM places", "FROM {places}"), places=places)
    met = S.boxes_meet(r, p, 64.0)
    return met.groupBy(F.col("r.place_id").alias("place_id")).agg(F.count("*").alias("n_roads"), F.min("l.road_id").alias("first_road"))


@query("sp14_anchor_distance", "places", "facilities", sql=f"SELECT p.place_id, round(sqrt(d2) / 50 * 111, 5) AS km FROM places p LEFT JOIN ({nearest_sql('places', 'place_id', 'facilities', 'facility_id', 250)}) n ON p.place_id = n.place_id")
def anchor(places: DataFrame, facilities: DataFrame) -> DataFrame:
    found = S.nearest(places, "place_id", facilities, "facility_id", "x", "y", 250.0, 60.0)
    return places.join(found, "place_id", "left").select("place_id", F.round(F.sqrt("d2") / 50 * C.KM_PER_DEG, 5).alias("km"))


@query("sp16_rounded_nodes", "roads", sql="SELECT DISTINCT round(lon, 1) AS lon, round(lat, 1) AS lat FROM roads")
def rounded(roads: DataFrame) -> DataFrame:
    return roads.select(F.round("lon", 1).alias("lon"), F.round("lat", 1).alias("lat")).distinct()


@query("sp18_tile_key", "pixels", sql="SELECT CAST(floor(lon / 4) AS BIGINT) AS tx, CAST(floor(lat / 4) AS BIGINT) AS ty, count(*) AS n FROM pixels GROUP BY 1, 2")
def tiles(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(F.floor(F.col("lon") / 4).alias("tx"), F.floor(F.col("lat") / 4).alias("ty")).agg(F.count("*").alias("n"))
