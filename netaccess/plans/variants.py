"""The grid of health variants: three facility sets by three snap thresholds by two mappings, for every country."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netaccess.operators import variants as V
from netaccess.plans.registry import query

#: Places as whole numbers, of which 200 make a degree; people live beside the nodes made of the same rows.
KM = 111.0 / 200
NODES = "SELECT node_id, country_id, (node_id * 53) % 997 AS x, (node_id * 71) % 991 AS y, t_normal / 2 AS t_normal, t_extreme / 2 AS t_extreme FROM access"
SITES = "SELECT site_id, country_id, x, y, concat(coalesce(lower(amenity), ''), ' ', lower(coalesce(name, ''))) AS text FROM sites"
PEOPLE = "SELECT pixel_id, country_id, (pixel_id * 53) % 997 + pixel_id % 11 * 6 AS x, (pixel_id * 71) % 991 + pixel_id % 13 * 6 AS y, CAST(floor(pop) AS BIGINT) AS weight FROM pixels"


def d2(a: str, b: str) -> str:
    return f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def first(name: str, key: str, left: str, right: str, other: str, on: str = "l.country_id = r.country_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT l.{key} AS k, r.*, {d2('l', 'r')} AS d2, row_number() OVER (PARTITION BY l.{key} ORDER BY {d2('l', 'r')}, {other}) AS rn FROM {left} l JOIN {right} r ON {on}) t WHERE rn = 1)"


SETS = " UNION ALL ".join(f"SELECT site_id, country_id, '{name}' AS facility_set FROM site WHERE regexp_matches(text, '{'|'.join(words)}')" for name, words in V.FACILITY_SETS.items())
LIMITS = f"(VALUES {', '.join(f'({t}::DOUBLE)' for t in V.SNAP_KM)}) h(threshold_km)"
BY = "country_id, facility_set, threshold_km, mapping"
SQL = f"""WITH node AS (SELECT * FROM ({NODES}) t WHERE t_normal IS NOT NULL AND t_extreme IS NOT NULL), has AS (SELECT DISTINCT country_id FROM node), site AS (SELECT * FROM ({SITES}) t WHERE country_id IN (SELECT country_id FROM has)), person AS (SELECT * FROM ({PEOPLE}) t WHERE weight > 0 AND country_id IN (SELECT country_id FROM has)),
    kn AS (SELECT l.country_id, l.x AS ax, l.y AS ay, r.x AS bx, r.y AS b_y, row_number() OVER (PARTITION BY l.node_id ORDER BY {d2('l', 'r')}, r.node_id) AS rn FROM node l JOIN node r ON l.country_id = r.country_id),
    proxy AS (SELECT country_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM node UNION SELECT country_id, (ax + bx) / 2.0::DOUBLE, (ay + b_y) / 2.0::DOUBLE FROM kn WHERE rn BETWEEN 2 AND {V.NEIGHBOURS + 1}), proxies AS (SELECT row_number() OVER (ORDER BY country_id, x, y) AS proxy, * FROM proxy),
    {first('pn', 'proxy', 'proxies', 'node', 'r.node_id')}, {first('sn', 'site_id', 'site', 'node', 'r.node_id')}, {first('sp', 'site_id', 'site', 'proxies', 'r.x, r.y')}, {first('wn', 'pixel_id', 'person', 'node', 'r.node_id')}, {first('wp', 'pixel_id', 'person', 'proxies', 'r.x, r.y')},
    snap AS (SELECT k AS site_id, 'nearest_node' AS mapping, node_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, sqrt(d2) * {KM!r}::DOUBLE AS km FROM sn UNION ALL SELECT sp.k, 'nearest_segment_proxy', pn.node_id, sp.x, sp.y, sqrt(sp.d2) * {KM!r}::DOUBLE FROM sp JOIN pn ON sp.proxy = pn.k),
    lives AS (SELECT k AS pixel_id, 'nearest_node' AS mapping, node_id, sqrt(d2) * {KM!r}::DOUBLE AS km FROM wn UNION ALL SELECT wp.k, 'nearest_segment_proxy', pn.node_id, sqrt(wp.d2) * {KM!r}::DOUBLE FROM wp JOIN pn ON wp.proxy = pn.k),
    placed AS (SELECT country_id, facility_set, threshold_km, mapping, node_id, x, y, km <= threshold_km AS kept FROM ({SETS}) s JOIN snap ON s.site_id = snap.site_id, {LIMITS}), counts AS (SELECT {BY}, count(*) AS n, count(*) FILTER (WHERE kept) AS m FROM placed GROUP BY {BY}),
    anchor AS (SELECT {BY}, x, y FROM placed WHERE kept UNION SELECT p.country_id, facility_set, threshold_km, mapping, CAST(node.x AS DOUBLE), CAST(node.y AS DOUBLE) FROM placed p JOIN node ON p.node_id = node.node_id WHERE kept),
    way AS (SELECT r.country_id, facility_set, threshold_km, mapping, l.node_id, any_value(t_normal) AS t0, any_value(t_extreme) AS t1, sqrt(min({d2('l', 'r')})) * {KM!r}::DOUBLE AS way FROM node l JOIN anchor r ON l.country_id = r.country_id GROUP BY r.country_id, facility_set, threshold_km, mapping, l.node_id),
    t AS (SELECT a.country_id, a.facility_set, a.threshold_km, a.mapping, a.node_id, greatest(0, a.t0 + coalesce(a.way - b.way, 0) / {V.SPEED_NORMAL}::DOUBLE) AS t0, greatest(0, a.t1 + coalesce(a.way - b.way, 0) / {V.SPEED_EXTREME}::DOUBLE) AS t1 FROM way a LEFT JOIN way b ON a.node_id = b.node_id AND a.mapping = b.mapping AND b.facility_set = '{V.DEFAULT_SET}' AND b.threshold_km = {V.DEFAULT_KM}),
    total AS (SELECT country_id, CAST(sum(weight) AS BIGINT) AS everyone FROM person GROUP BY country_id), near AS (SELECT country_id, mapping, threshold_km, node_id, CAST(sum(weight) AS BIGINT) AS w FROM lives JOIN person ON lives.pixel_id = person.pixel_id, {LIMITS} WHERE km <= threshold_km GROUP BY country_id, mapping, threshold_km, node_id),
    inc AS (SELECT country_id, mapping, threshold_km, CAST(sum(w) AS BIGINT) AS included FROM near GROUP BY country_id, mapping, threshold_km), rows AS (SELECT t.*, w, t1 - t0 AS delay FROM t JOIN near ON t.country_id = near.country_id AND t.mapping = near.mapping AND t.threshold_km = near.threshold_km AND t.node_id = near.node_id),
    upto AS (SELECT *, sum(w) OVER (PARTITION BY {BY} ORDER BY delay) AS u, sum(w) OVER (PARTITION BY {BY}) AS a FROM rows),
    s AS (SELECT {BY}, CAST(coalesce(sum(CASE WHEN t0 <= 1 THEN w END), 0) AS BIGINT) AS c0, CAST(coalesce(sum(CASE WHEN t1 <= 1 THEN w END), 0) AS BIGINT) AS c1, sum(delay * w) / sum(w) AS mean_delay, min(CASE WHEN u >= 0.5::DOUBLE * a THEN delay END) AS q50, min(CASE WHEN u >= 0.9::DOUBLE * a THEN delay END) AS q90 FROM upto GROUP BY {BY}),
    grid AS (SELECT * FROM (SELECT DISTINCT country_id FROM site) c, (VALUES {', '.join(f"('{n}')" for n in V.FACILITY_SETS)}) f(facility_set), {LIMITS}, (VALUES ('nearest_node'), ('nearest_segment_proxy')) g(mapping))
    SELECT country_id, facility_set, threshold_km, mapping, coalesce(n, 0) AS n_facilities, coalesce(m, 0) AS n_facility_anchors, round((1 - CAST(m AS DOUBLE) / n) * 100, 3) AS excluded_facility_pct, round((1 - CAST(coalesce(included, 0) AS DOUBLE) / everyone) * 100, 3) AS excluded_population_pct, CASE WHEN c0 IS NOT NULL THEN included END AS included_population,
    c0 AS normal_covered_1h, c1 AS extreme_covered_1h, round(CAST(c0 - c1 AS DOUBLE) / nullif(c0, 0), 6) AS one_hour_coverage_loss, round(CASE WHEN q50 > 0 THEN q90 / q50 END, 6) AS tail_gap_ratio, round(mean_delay, 6) AS pwmtt_delta, CASE WHEN c0 IS NOT NULL THEN 'ok' ELSE 'no_anchors_or_population' END AS status
    FROM grid LEFT JOIN counts USING ({BY}) LEFT JOIN total USING (country_id) LEFT JOIN inc USING (country_id, mapping, threshold_km) LEFT JOIN s USING ({BY})"""


@query("ac8_health_variants", "access", "sites", "pixels", sql=SQL)
def health_variants(access: DataFrame, sites: DataFrame, pixels: DataFrame) -> DataFrame:
    """All eighteen variants of every country in one pass: sets, thresholds and mappings are keys, not runs."""
    spark = access.sparkSession
    bind = lambda sql, **frame: spark.sql(sql.replace(f"FROM {next(iter(frame))}", f"FROM {{{next(iter(frame))}}}"), **frame)
    return V.health_variants(bind(NODES, access=access), bind(SITES, sites=sites), bind(PEOPLE, pixels=pixels), KM)
