"""Domain views over the star-schema tables: roads, edges, places, climate, access nodes and the like.

Each view is a deterministic projection that is the same statement in Spark SQL and ANSI SQL, so that a query and its twin
start from equal rows. ``views`` registers those a query needs; ``with_sql`` puts them in front of a twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netaccess.runtime import table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "country": (("nation", "region"), """
        SELECT CAST(n_nationkey AS BIGINT) AS country_id, n_name AS country, CAST(n_regionkey AS BIGINT) AS region_id, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "places": (("supplier",), """
        SELECT s_suppkey AS place_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS country_id,
               (s_suppkey * 37) % 1000 AS x, (s_suppkey * 91) % 1000 AS y,
               CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 50 AS lon, CAST((s_suppkey * 91) % 1000 AS DOUBLE) / 50 AS lat,
               CAST(floor(greatest(s_acctbal, 0) * 100) AS BIGINT) AS pop_max,
               CASE WHEN s_suppkey % 10 = 0 THEN 'Admin-0 capital' WHEN s_suppkey % 10 IN (1, 2) THEN 'Admin-1 capital' ELSE 'Populated place' END AS featurecla,
               CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS megacity
        FROM supplier"""),
    "facilities": (("supplier",), """
        SELECT s_suppkey AS facility_id, CAST(s_nationkey AS BIGINT) AS country_id, (s_suppkey * 37) % 1000 AS x, (s_suppkey * 91) % 1000 AS y,
               CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 50 AS lon, CAST((s_suppkey * 91) % 1000 AS DOUBLE) / 50 AS lat,
               CASE s_suppkey % 4 WHEN 0 THEN 'Hospital' WHEN 1 THEN 'clinic' WHEN 2 THEN 'Pharmacy' END AS amenity, s_name AS name
        FROM supplier WHERE s_suppkey % 5 = 0"""),
    "sites": (("part",), """
        SELECT p_partkey AS site_id, p_partkey % 25 AS country_id, (p_partkey * 37) % 1000 AS x, (p_partkey * 91) % 1000 AS y,
               CASE p_partkey % 4 WHEN 0 THEN 'Hospital' WHEN 1 THEN 'clinic' WHEN 2 THEN 'Pharmacy' END AS amenity, p_name AS name
        FROM part"""),
    "pixels": (("customer",), """
        SELECT c_custkey AS pixel_id, CAST(c_nationkey AS BIGINT) AS country_id, (c_custkey * 53) % 997 AS x, (c_custkey * 71) % 991 AS y,
               CAST((c_custkey * 53) % 997 AS DOUBLE) / 50 AS lon, CAST((c_custkey * 71) % 991 AS DOUBLE) / 50 AS lat, greatest(c_acctbal, 0) AS pop
        FROM customer"""),
    "roads": (("lineitem", "supplier"), """
        SELECT concat('r', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS road_id, l_partkey AS u, 1000000 + l_suppkey AS v,
               CAST(max(s_nationkey) AS BIGINT) AS country_id, max(l_quantity) AS length_km, 32 + max(l_quantity) AS v_normal,
               (32 + max(l_quantity)) * (1 - max(l_discount)) * (1 - max(l_tax)) AS v_extreme, 1 - max(l_discount) AS pass_extreme,
               CASE min(l_returnflag) WHEN 'N' THEN 'Unpaved road' WHEN 'R' THEN 'paved' END AS surface,
               CAST((l_partkey * 53) % 1000 AS DOUBLE) / 50 AS lon, CAST((l_suppkey * 91) % 1000 AS DOUBLE) / 50 AS lat
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey"""),
    "edges": (("roads",), """
        SELECT road_id, u, v, country_id, length_km, surface, length_km / v_normal AS w0,
               length_km / v_extreme / (1 - least(greatest(1 - pass_extreme, 0), 0.99)) AS w1, greatest(1 - pass_extreme, 0) AS p_block
        FROM roads"""),
    "edges_s": (("orders", "lineitem"), """
        SELECT o_custkey AS u, 10000000 + l_partkey AS v, min(l_quantity) AS w0, min(l_quantity) * (1 + max(l_tax)) AS w1
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey"""),
    "climate": (("lineitem",), """
        SELECT l_suppkey AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice) / 10000 AS pr, avg(l_quantity) AS mrso
        FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)"""),
    "access": (("customer", "orders"), """
        SELECT c_custkey AS node_id, CAST(c_nationkey AS BIGINT) AS country_id, CAST((c_custkey * 53) % 997 AS DOUBLE) / 50 AS lon, CAST((c_custkey * 71) % 991 AS DOUBLE) / 50 AS lat,
               CASE WHEN c_custkey % 13 <> 0 THEN min(o_totalprice) / 100000 END AS t_normal,
               CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 THEN min(o_totalprice) / 100000 * (1 + CAST(c_custkey % 7 AS DOUBLE) / 10) END AS t_extreme,
               greatest(max(c_acctbal), 0) AS population
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey"""),
    "districts": (("lineitem", "supplier"), """
        SELECT CAST(s_nationkey AS BIGINT) AS country_id, l_partkey % 25 AS district_id, count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS n_nodes, count(*) AS n_edges,
               1 - avg(l_discount) AS lcc_ratio, avg(l_tax) AS bridge_ratio, sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS n_critical, avg(l_discount) * 100 AS road_drop, avg(l_discount * l_tax) AS p_block,
               CASE WHEN min(l_orderkey) % 9 <> 0 THEN avg(l_quantity) / 100 ELSE 0 END AS e_normal, avg(l_quantity * (1 - l_discount) * (1 - l_tax)) / 100 AS e_extreme,
               max(l_quantity) AS d_normal, max(l_quantity * (1 + l_tax)) AS d_extreme, max(l_linenumber) - min(l_linenumber) AS new_parts,
               CASE WHEN max(l_orderkey) % 7 <> 0 THEN avg(l_tax) * 10 END AS q_c, avg(l_discount) * 8 AS fall_at_q_c
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_partkey % 25"""),
    "scores": (("lineitem", "supplier"), """
        SELECT l_partkey * 100000 + l_suppkey AS edge_id, l_partkey AS u, 1000000 + l_suppkey AS v, CAST(max(s_nationkey) AS BIGINT) AS country_id,
               sum(l_extendedprice) AS ni, max(l_tax) AS cv, max(l_quantity) AS w0, max(l_quantity) * (1 + max(l_tax)) AS w1
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey"""),
    "net": (("lineitem", "supplier"), """
        SELECT l_partkey * 100000 + l_suppkey AS edge_id, l_partkey AS u, 1000000 + l_suppkey AS v, CAST(max(s_nationkey) AS BIGINT) AS country_id, sum(l_extendedprice) AS ni,
               max(l_tax) * CAST(max(l_linenumber) AS DOUBLE) * 2 AS cv, max(l_quantity) / 5 AS w0, max(l_quantity) / 5 * (1 + max(l_tax) * CAST(max(l_linenumber) AS DOUBLE) * 2) AS w1
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey"""),
    "od": (("lineitem", "supplier"), """
        SELECT a.city_a, a.city_b, CAST(p.s_nationkey AS BIGINT) AS country_a, CAST(q.s_nationkey AS BIGINT) AS country_b, a.t0, a.t1
        FROM (SELECT least(l_suppkey, 1 + l_partkey % 10) AS city_a, greatest(l_suppkey, 1 + l_partkey % 10) AS city_b,
                     CASE WHEN max(l_orderkey) % 17 <> 0 THEN min(l_extendedprice) / 10000 END AS t0,
                     CASE WHEN max(l_orderkey) % 5 <> 0 THEN min(l_extendedprice) / 10000 * (1 + max(l_tax) * CAST(max(l_linenumber) AS DOUBLE) * 2) END AS t1
              FROM lineitem WHERE l_suppkey <> 1 + l_partkey % 10
              GROUP BY least(l_suppkey, 1 + l_partkey % 10), greatest(l_suppkey, 1 + l_partkey % 10)) a
        JOIN supplier p ON a.city_a = p.s_suppkey JOIN supplier q ON a.city_b = q.s_suppkey"""),
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The named tables and views and all below them, lowest first."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in VIEWS[name][0] if name in VIEWS else ():
            add(below)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return order


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named tables or views as DataFrames; nothing runs before they are used."""
    frames: dict[str, DataFrame] = {}
    for name in needed(names):
        if name in VIEWS:
            below, sql = VIEWS[name]
            frames[name] = spark.sql(sql_with_slots(sql, below), **{b: frames[b] for b in below})
        else:
            frames[name] = table(spark, sf_dir, name)
    return frames


def sql_with_slots(sql: str, below: tuple[str, ...]) -> str:
    """Table names after FROM and JOIN as parameters of ``spark.sql``."""
    for name in below:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name}", f"{word} {{{name}}}")
    return sql


def with_sql(names: tuple[str, ...], sql: str) -> str:
    """A twin statement with the views that it names in front, recursive or not."""
    heads = [f"{n} AS ({VIEWS[n][1].replace('AS STRING', 'AS VARCHAR')})" for n in needed(names) if n in VIEWS]
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(heads)}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {', '.join(heads)}, {body[len('WITH'):]}"
    return f"WITH {', '.join(heads)} {body}"
