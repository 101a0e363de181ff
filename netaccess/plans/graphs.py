"""Queries of graph construction and algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.graph import build as B
from netaccess.graph import paths as P
from netaccess.graph import structure as G
from netaccess.graph.blocks import block_times
from netaccess.graph.components import connected_components
from netaccess.plans.registry import query
from netaccess.runtime import materialize

LABELS = """WITH RECURSIVE adj AS (SELECT u AS a, v AS b FROM edges_s UNION ALL SELECT v, u FROM edges_s), lab(node, label) USING KEY (node) AS (
    SELECT a, min(least(a, b)) FROM adj GROUP BY a UNION SELECT adj.b, min(lab.label) FROM lab JOIN adj ON lab.node = adj.a JOIN recurring.lab AS r ON r.node = adj.b WHERE lab.label < r.label GROUP BY adj.b)"""


def paths_sql(sources: str, w: str = "w0", edges: str = "edges") -> str:
    return f"""WITH RECURSIVE adj AS (SELECT u AS a, v AS b, {w} AS w FROM {edges} UNION ALL SELECT v, u, {w} FROM {edges}), d(src, node, dist) USING KEY (src, node) AS (
    {sources} UNION SELECT d.src, adj.b, min(d.dist + adj.w) FROM d JOIN adj ON d.node = adj.a LEFT JOIN recurring.d AS r ON r.src = d.src AND r.node = adj.b WHERE d.dist + adj.w < coalesce(r.dist, 1e300) GROUP BY d.src, adj.b)"""


@query("gr1_endpoint_merge", "pixels")
def endpoint_merge(pixels: DataFrame) -> DataFrame:
    ends = pixels.select(F.col("pixel_id").alias("end_id"), F.floor(F.col("pixel_id") / 2).alias("segment"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return B.merge_endpoints(ends, 6.0).select("end_id", "node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("gr2_parallel_edges", "lineitem", sql="""SELECT u, v, round(min(w0), 6) AS w0, count(*) AS n FROM (SELECT l_suppkey AS u, 1000000 + l_partkey % 500 AS v, l_quantity / (32 + l_quantity) AS w0 FROM lineitem) t GROUP BY u, v""")
def parallel(lineitem: DataFrame) -> DataFrame:
    raw = lineitem.select(F.col("l_suppkey").alias("u"), (1_000_000 + F.col("l_partkey") % 500).alias("v"), (F.col("l_quantity") / (32 + F.col("l_quantity"))).alias("w0"), F.col("l_tax").alias("w1"), F.col("l_orderkey").alias("road_id"))
    n = raw.groupBy("u", "v").agg(F.count("*").alias("n"))
    return B.simple_edges(raw).join(n, ["u", "v"]).select("u", "v", F.round("w0", 6).alias("w0"), "n")


@query("gr5_components", "edges_s", sql=f"{LABELS} SELECT node, label AS component FROM lab")
def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


@query("gr5_largest_component", "edges_s", sql=f"{LABELS}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label) SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS component, max(n) AS n_nodes, count(*) AS n_components, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS ratio FROM c")
def largest(edges: DataFrame) -> DataFrame:
    sizes = connected_components(edges).groupBy("component").agg(F.count("*").alias("n"))
    best = F.max_by("component", F.struct("n", -F.col("component")))
    return sizes.agg(best.alias("component"), F.max("n").alias("n_nodes"), F.count("*").alias("n_components"), F.round(F.max("n") / F.sum("n"), 6).alias("ratio"))


FACILITY_START = "SELECT CAST(0 AS BIGINT) AS src, 1000000 + facility_id AS node, CAST(0.0 AS DOUBLE) AS dist FROM facilities"


def facility_times(edges: DataFrame, facilities: DataFrame, weight: str) -> DataFrame:
    """Time to the nearest facility from every node that reaches one."""
    starts = facilities.select(F.lit(0).cast("bigint").alias("src"), (1_000_000 + F.col("facility_id")).alias("node"))
    return P.shortest_paths(B.both_ways(edges, weight), starts)


@query("gr6_multi_source_sp", "edges", "facilities", sql=paths_sql(FACILITY_START) + " SELECT node, round(dist, 6) AS dist FROM d")
def multi_source(edges: DataFrame, facilities: DataFrame) -> DataFrame:
    return facility_times(edges, facilities, "w0").select("node", F.round("dist", 6).alias("dist"))


CITY = "SELECT v AS src, v AS node, CAST(0.0 AS DOUBLE) AS dist FROM (SELECT DISTINCT v FROM edges) c"


def place_nodes(edges: DataFrame) -> DataFrame:
    """Every place on the network, as node."""
    return edges.select(F.col("v").alias("node")).distinct()


@query("gr7_many_to_many", "edges", sql=paths_sql(CITY) + " SELECT src, node, round(dist, 6) AS dist FROM d")
def many_to_many(edges: DataFrame) -> DataFrame:
    """Times from every place to every node."""
    rows = edges.withColumn("net", F.lit(0))
    starts = place_nodes(edges).select(F.lit(0).alias("net"), F.col("node").alias("src"), "node")
    return block_times(rows, ["w0"], starts).select("src", "node", F.round("w0", 6).alias("dist"))


@query("gr8_forced_path", "edges", "facilities")
def forced_path(edges: DataFrame, facilities: DataFrame) -> DataFrame:
    """Extra time at every node if drivers keep their normal paths under extreme weather."""
    from netaccess.operators.access import forced_degradation

    return forced_degradation(edges, facilities).select("node", F.round("t_normal", 6).alias("t_normal"), F.round("direct_degradation", 6).alias("direct_degradation"))


def metrics_sql(nets: str) -> str:
    """CTEs that end in m, the metrics of every net of ``nets`` (net, u, v, w)."""
    return f"""WITH RECURSIVE nets AS ({nets}), adj AS (SELECT net, u AS a, v AS b, w FROM nets UNION ALL SELECT net, v, u, w FROM nets),
    lab(net, node, label) USING KEY (net, node) AS (SELECT net, a, min(least(a, b)) FROM adj GROUP BY net, a UNION SELECT adj.net, adj.b, min(lab.label) FROM lab JOIN adj ON lab.net = adj.net AND lab.node = adj.a
    JOIN recurring.lab AS r ON r.net = adj.net AND r.node = adj.b WHERE lab.label < r.label GROUP BY adj.net, adj.b),
    sizes AS (SELECT net, label, count(*) AS n FROM lab GROUP BY net, label), shape AS (SELECT net, CAST(sum(n) AS BIGINT) AS n_nodes, count(*) AS n_components, max(n) AS n, first(label ORDER BY n DESC, label) AS best FROM sizes GROUP BY net),
    starts AS (SELECT lab.net, row_number() OVER (PARTITION BY lab.net ORDER BY node) AS src, node FROM lab JOIN shape ON lab.net = shape.net AND lab.label = shape.best),
    d(net, src, node, dist) USING KEY (net, src, node) AS (SELECT net, src, node, CAST(0.0 AS DOUBLE) FROM starts WHERE src <= {C.EFFICIENCY_SAMPLE} UNION SELECT d.net, d.src, adj.b, min(d.dist + adj.w) FROM d JOIN adj ON d.net = adj.net AND d.node = adj.a
    LEFT JOIN recurring.d AS r ON r.net = d.net AND r.src = d.src AND r.node = adj.b WHERE d.dist + adj.w < coalesce(r.dist, 1e300) GROUP BY d.net, d.src, adj.b),
    m AS (SELECT shape.net, n_nodes, n_components, CAST(n AS DOUBLE) / n_nodes AS lcc_ratio, coalesce(sum(CASE WHEN dist > 0 THEN 1 / dist END) / nullif(least(n, {C.EFFICIENCY_SAMPLE}) * (n - 1), 0), 0) AS efficiency,
    max(CASE WHEN n <= {C.EFFICIENCY_SAMPLE} OR src <= {C.DIAMETER_SAMPLE} THEN dist END) AS diameter FROM shape JOIN d ON shape.net = d.net GROUP BY shape.net, n_nodes, n_components, n)"""


def one_net(edges: DataFrame, weight: str) -> DataFrame:
    return edges.select(F.lit(0).alias("net"), "u", "v", F.col(weight).alias("w"))


def three_nets(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges as the nets 0 (normal), 1 (extreme) and 2 (hops), beside ``keys``."""
    weights = F.posexplode(F.array(F.col("w0"), F.col("w1"), F.lit(1.0))).alias("kind", "w")
    rows = edges.select(*keys, "u", "v", weights)
    return rows.withColumn("net", F.struct(*keys, "kind") if keys else F.col("kind")).select("net", "u", "v", "w")


@query("gr9_sampled_efficiency", "edges", sql=metrics_sql("SELECT 0 AS net, u, v, w0 AS w FROM edges") + " SELECT round(efficiency, 6) AS efficiency FROM m")
def efficiency(edges: DataFrame) -> DataFrame:
    """From the 300 least nodes of the largest part."""
    return G.network_metrics(one_net(edges, "w0")).select(F.round("efficiency", 6).alias("efficiency"))


@query("gr10_diameter", "edges", sql=metrics_sql("SELECT 0 AS net, u, v, w1 AS w FROM edges") + " SELECT round(diameter, 6) AS diameter FROM m")
def diameter(edges: DataFrame) -> DataFrame:
    """Of the largest part: exact up to 300 nodes, else from its 150 least nodes."""
    return G.network_metrics(one_net(edges, "w1")).select(F.round("diameter", 6).alias("diameter"))


@query("gr12_bridges", "edges_s")
def find_bridges(edges: DataFrame) -> DataFrame:
    return G.bridges(edges)


@query("gr13_edge_betweenness", "edges_s")
def betweenness(edges: DataFrame) -> DataFrame:
    """From the 300 least nodes, ties split over all shortest paths, normalised."""
    return G.edge_betweenness(edges, "w0").select("u", "v", F.round("load", 9).alias("load"))


def percolation_curve(edges: DataFrame) -> DataFrame:
    """Every country is a district; its worst edges, by block probability and time lost, go first."""
    district = edges.select(F.col("country_id").alias("district"), "u", "v", "p_block", (F.col("w1") - F.col("w0")).alias("dv"))
    most = district.join(district.groupBy("district").agg(F.max("dv").alias("most")), "district")
    score = C.PERCOLATION_ALPHA * F.col("p_block") + (1 - C.PERCOLATION_ALPHA) * F.coalesce(F.try_divide("dv", "most"), F.lit(0.0))
    return G.percolation(most, score)


@query("gr15_percolation", "edges")
def percolate(edges: DataFrame) -> DataFrame:
    return percolation_curve(edges).select("district", "step", F.round("share", 6).alias("share"), F.round("efficiency", 6).alias("efficiency"))


@query("gr15_tipping_point", "edges")
def tipping(edges: DataFrame) -> DataFrame:
    names = ("q_c", "share", "efficiency_drop", "amplification")
    return G.tipping_point(materialize(percolation_curve(edges), "percolation-curve")).select("district", *(F.round(c, 6).alias(c) for c in names))


@query("gr16_degree", "edges", sql="SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) t GROUP BY node")
def degree(edges: DataFrame) -> DataFrame:
    return B.degrees(edges)


@query("gr17_gravity_betweenness", "edges", "places")
def gravity(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Every pair of places adds the product of their populations over the squared time to the edges of one shortest path."""
    people = places.select((1_000_000 + F.col("place_id")).alias("node"), (F.col("pop_max") / 1000).alias("pop"))
    return G.gravity_loads(edges, people, "w0").select("u", "v", F.round("load", 4).alias("load"))


@query("gr18_edge_scores", "scores", sql="""WITH s AS (SELECT edge_id, ni, greatest(CASE WHEN w0 > 1e-9 THEN w1 / w0 - 1 ELSE 0 END, 0) AS c FROM scores), m AS (SELECT max(ni) AS mn, max(c) AS mc FROM s)
    SELECT edge_id, round(c, 6) AS cv, round(ni / mn * coalesce(c / nullif(mc, 0), 0), 6) AS bottleneck, CASE WHEN round(c, 9) > 0.02 THEN 1 ELSE 0 END AS unpaved FROM s, m""")
def scored(scores: DataFrame) -> DataFrame:
    rows = B.edge_scores(scores.drop("cv"))
    return rows.select("edge_id", F.round("cv", 6).alias("cv"), F.round("bottleneck", 6).alias("bottleneck"), (F.round("cv", 9) > C.CV_MIN).cast("int").alias("unpaved"))


@query("gr19_demand_nodes", "pixels", "places")
def demand(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """Populous cells all, others sampled by population, each at its nearest place."""
    from netaccess.operators.spatial import nearest

    cells = pixels.groupBy(F.floor(F.col("lon") * 2).alias("cx"), F.floor(F.col("lat") * 2).alias("cy")).agg(F.sum("pop").alias("pop"), F.min("pixel_id").alias("pixel_id"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    cells = materialize(cells, "demand-cells")
    urban = cells.filter("pop > 8000")
    rural = B.weighted_sample(cells.filter("pop > 1000 AND pop <= 8000"), "pixel_id", F.col("pop"), C.RURAL_SAMPLE)
    chosen = materialize(urban.unionByName(rural), "demand-chosen")
    at = nearest(chosen, "pixel_id", places, "place_id", "x", "y", 100.0, 50.0)
    return at.join(chosen, "pixel_id").groupBy("place_id").agg(F.round(F.sum("pop"), 2).alias("population"), F.count("*").alias("n_cells"))


@query("gr4_border_links", "pixels")
def border_links(pixels: DataFrame) -> DataFrame:
    """Edges between nodes of different countries near their borders, timed at the border speed."""
    from netaccess.operators.spatial import within

    box = pixels.groupBy("country_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    band = pixels.join(box, "country_id").filter("x - x0 <= 25 OR x1 - x <= 25 OR y - y0 <= 25 OR y1 - y <= 25").select("pixel_id", "country_id", "x", "y")
    near = within(band, band, "x", "y", 10.0).filter("l.pixel_id < r.pixel_id AND l.country_id <> r.country_id")
    hours = F.sqrt("d2") / 50 * C.KM_PER_DEG / C.BORDER_SPEED
    return near.select(F.col("l.pixel_id").alias("u"), F.col("r.pixel_id").alias("v"), F.round(hours, 6).alias("w0"), F.round(hours, 6).alias("w1"))


NODE_XY = "(node * 53 + country * 101) % 1000 AS x, (node * 71 + country * 37) % 997 AS y"
MERGED_SQL = f"""WITH RECURSIVE nodes AS (SELECT country, node, {NODE_XY} FROM (SELECT country_id AS country, u AS node FROM edges UNION SELECT country_id, v FROM edges) t), k AS (SELECT country, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes GROUP BY country),
    num AS (SELECT nodes.*, row_number() OVER (ORDER BY country, node) - 1 AS id FROM nodes), raw AS (SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, w0, w1 FROM edges e JOIN num a ON e.country_id = a.country AND e.u = a.node JOIN num b ON e.country_id = b.country AND e.v = b.node),
    inside AS (SELECT u, v, w0, w1 FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY w0, w1) AS r FROM raw) t WHERE r = 1), band AS (SELECT num.* FROM num JOIN k ON num.country = k.country WHERE x - x0 <= 25 OR x1 - x <= 25 OR y - y0 <= 25 OR y1 - y <= 25),
    link AS (SELECT a.id AS u, b.id AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * {C.KM_PER_DEG / 50 / C.BORDER_SPEED!r}::DOUBLE AS w FROM (SELECT *, x // 10 + i AS bx, y // 10 + j AS b_y FROM band, (VALUES (-1), (0), (1)) p(i), (VALUES (-1), (0), (1)) q(j)) a JOIN band b ON a.bx = b.x // 10 AND a.b_y = b.y // 10 WHERE a.id < b.id AND a.country <> b.country AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100),
    m AS (SELECT u, v, w0, w1, false AS is_border FROM inside UNION ALL SELECT u, v, w, w, true FROM link l WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.u = l.u AND i.v = l.v)), adj AS (SELECT u AS a, v AS b FROM m UNION ALL SELECT v, u FROM m),
    lab(node, label) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM adj GROUP BY a UNION SELECT adj.b, min(lab.label) FROM lab JOIN adj ON lab.node = adj.a JOIN recurring.lab AS r ON r.node = adj.b WHERE lab.label < r.label GROUP BY adj.b)
    SELECT u, v, round(w0, 6) AS w0, round(w1, 6) AS w1, is_border, label AS component FROM m JOIN lab ON m.u = lab.node"""


@query("gr4_continent_merge", "edges", sql=MERGED_SQL)
def continent_merge(edges: DataFrame) -> DataFrame:
    """All country nets with their border links as one net, each edge with the part that it lies in."""
    own = edges.select(F.col("country_id").alias("country"), "u", "v", "w0", "w1")
    nodes = own.select("country", F.explode(F.array("u", "v")).alias("node")).distinct().selectExpr("country", "node", *NODE_XY.split(", "))
    _, merged = B.merge_countries(own, nodes, 25.0, 10.0, C.KM_PER_DEG / 50 / C.BORDER_SPEED)
    merged = materialize(merged, "merged-edges")
    parts = connected_components(merged)
    return merged.join(parts.withColumnRenamed("node", "u"), "u").select("u", "v", F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"), "is_border", "component")


@query("gr12_country_bridges", "edges")
def country_bridges(edges: DataFrame) -> DataFrame:
    """Edges whose loss parts a country's own net; nodes carry their country."""
    own = lambda c: (F.col("country_id") * 10_000_000 + F.col(c)).alias(c)
    found = G.bridges(edges.select(own("u"), own("v")))
    return found.select(F.floor(F.col("u") / 10_000_000).alias("country_id"), (F.col("u") % 10_000_000).alias("u"), (F.col("v") % 10_000_000).alias("v"))


@query("gr11_metric_deltas", "edges", sql=metrics_sql("SELECT 0 AS net, u, v, w0 AS w FROM edges UNION ALL SELECT 1, u, v, w1 FROM edges UNION ALL SELECT 2, u, v, CAST(1.0 AS DOUBLE) FROM edges") + """,
    s AS (SELECT *, max(CASE WHEN net = 0 THEN efficiency END) OVER () AS e0, max(CASE WHEN net = 0 THEN diameter END) OVER () AS d0, max(CASE WHEN net = 0 THEN n_components END) OVER () AS c0 FROM m)
    SELECT net, n_nodes, n_components, round(lcc_ratio, 6) AS lcc_ratio, round(efficiency, 6) AS efficiency, round(diameter, 6) AS diameter,
    CASE WHEN net = 1 AND e0 > 0 THEN round((e0 - efficiency) / e0 * 100, 5) END AS efficiency_loss_pct, CASE WHEN net = 1 THEN round(diameter - d0, 6) END AS diameter_delta, CASE WHEN net = 1 THEN n_components - c0 END AS new_components FROM s""")
def metric_deltas(edges: DataFrame) -> DataFrame:
    """Metrics of the nets 0 (normal), 1 (extreme) and 2 (hops), and what extreme weather changes."""
    rows = materialize(G.network_metrics(three_nets(edges)), "metrics")
    normal = F.broadcast(rows.filter("net = 0").select(F.col("efficiency").alias("e0"), F.col("diameter").alias("d0"), F.col("n_components").alias("c0")))
    extreme = lambda c, k: F.when(F.col("net") == 1, c).alias(k)
    return rows.crossJoin(normal).select(
        "net", "n_nodes", "n_components", *(F.round(c, 6).alias(c) for c in ("lcc_ratio", "efficiency", "diameter")),
        extreme(F.when(F.col("e0") > 0, F.round((F.col("e0") - F.col("efficiency")) / F.col("e0") * 100, 5)), "efficiency_loss_pct"),
        extreme(F.round(F.col("diameter") - F.col("d0"), 6), "diameter_delta"), extreme(F.col("n_components") - F.col("c0"), "new_components"),
    )


@query("gr14_critical_tiers", "scores", sql="""WITH q AS (SELECT quantile_cont(ni, 0.8) AS a, quantile_cont(ni, 0.9) AS b, quantile_cont(ni, 0.95) AS c FROM scores) SELECT edge_id, CASE WHEN cv >= 0.05 AND ni >= b THEN 'L1' WHEN cv >= 0.05 OR ni >= c THEN 'L2' ELSE 'L3' END AS tier FROM scores, q WHERE cv >= 0.05 OR ni >= a""")
def critical_tiers(scores: DataFrame) -> DataFrame:
    from netaccess.operators.sets import road_tiers

    return road_tiers(scores, F.col("cv") >= 0.05, "ni").select("edge_id", "tier")
