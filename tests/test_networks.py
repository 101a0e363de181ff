"""Whole-table quantiles, unbounded nearest neighbours, line measures and the country driver against brute force."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from netaccess.operators import lines as L
from netaccess.operators.measures import district_rollup
from netaccess.operators.ranking import grouped_quantiles, quantiles
from netaccess.operators.spatial import nearest
from netaccess.plans import registry, networks  # noqa: I001 - the registry loads the query modules


def test_quantiles_equal_interpolated_ones(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 40)), rng.random() if rng.random() < 0.8 else None) for _ in range(500)]
    got = quantiles(spark.createDataFrame(rows, "a double, b double").repartition(7), {"a": (F.col("a"), (0.0, 0.5, 0.99)), "b": (F.col("b"), (0.25, 1.0))}).first()
    want = [*np.quantile([a for a, _ in rows], (0.0, 0.5, 0.99)), *np.quantile([b for _, b in rows if b is not None], (0.25, 1.0))]
    assert np.allclose(list(got), want)


def test_quantiles_of_nothing_are_null(spark):
    got = quantiles(spark.createDataFrame([(None, 2.0)], "a double, b double"), {"a": (F.col("a"), (0.5,)), "b": (F.col("b"), (0.5,))}).first()
    assert got["a_0"] is None and got["b_0"] == 2.0
    assert quantiles(spark.createDataFrame([], "a double"), {"a": (F.col("a"), (0.5,))}).first()["a_0"] is None


def test_nearest_without_limit(spark):
    rng = random.Random(5)
    a = [(i, rng.randint(0, 30) + (900 if i == 0 else 0), rng.randint(0, 30)) for i in range(40)]
    b = [(i, rng.randint(0, 30), rng.randint(0, 30)) for i in range(25)]
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} long, x long, y long")
    got = {r["l"]: (r["d2"], r["r"]) for r in nearest(frame(a, "l"), "l", frame(b, "r"), "r", "x", "y").collect()}
    assert got == {i: min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b) for i, x, y in a}
    assert nearest(frame(a, "l"), "l", frame([], "r"), "r", "x", "y").count() == 0


def test_line_measures(spark):
    rows = [(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0)]), (2, [(5.0, 5.0)]), (3, []), (4, [(1.0, 1.0), (1.0, 1.0), (1.0, 5.0)])]
    df = spark.createDataFrame(rows, "id int, line array<struct<x:double,y:double>>")
    steps = L.line_steps(F.col("line"))
    mid = L.point_along(F.col("line"), steps, 0.5)
    got = {r["id"]: r for r in df.select("id", L.line_length(steps).alias("n"), mid["x"].alias("x"), mid["y"].alias("y"), L.line_centroid(F.col("line"), steps, "x").alias("cx")).collect()}
    assert (got[1]["n"], got[1]["x"], got[1]["y"], got[1]["cx"]) == (4.0, 2.0, 0.0, (1.5 * 3 + 3) / 4)
    assert (got[2]["n"], got[2]["x"], got[2]["cx"]) == (0.0, 5.0, 5.0)
    assert got[3]["x"] is None and got[3]["cx"] is None
    assert (got[4]["x"], got[4]["y"]) == (1.0, 3.0)


def test_new_queries_are_registered():
    assert {"sc7_graph_roads", "gr3_renumber", "sp15_network_mapping", "od8_country_driver"} <= set(registry.QUERIES)


def test_country_driver_takes_the_largest_unpaved_part(spark):
    rng = random.Random(7)
    rows = [(f"r{u}{v}", u, v, float(rng.randint(1, 9)), "unpaved" if (u + v) % 5 else "paved") for u in range(1, 7) for v in range(100, 104) if rng.random() < 0.6]
    rows += [("far", 50, 150, 2.0, "Unpaved"), ("far2", 51, 150, 2.0, "Unpaved")]
    rows = [(r, u, v, w, s, w, w * (1 + (u % 3) / 2)) for r, u, v, w, s in rows]
    got = networks.country_driver(spark.createDataFrame(rows, "road_id string, u long, v long, length_km double, surface string, w0 double, w1 double")).first()

    kept = [r for r in rows if "unpaved" in r[4].lower()]
    part = {n: n for r in kept for n in r[1:3]}
    for _ in part:
        for r in kept:
            part[r[1]] = part[r[2]] = min(part[r[1]], part[r[2]])
    best = min(set(part.values()), key=lambda k: (-list(part.values()).count(k), k))
    nodes = sorted(n for n in part if part[n] == best)
    dist = []
    for weight in (5, 6):
        d = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
        for r in kept:
            if r[1] in nodes:
                d[r[1], r[2]] = d[r[2], r[1]] = min(d[r[1], r[2]], r[weight])
        for k, a, b in itertools.product(nodes, nodes, nodes):
            d[a, b] = min(d[a, b], d[a, k] + d[k, b])
        dist.append(d)
    places = [n for n in nodes if n >= 100]
    slower = [(dist[1][p] - dist[0][p]) / dist[0][p] * 100 for p in itertools.combinations(places, 2)]
    assert got["n_cities"] == len(places) and got["n_city_pairs"] == got["n_connected"] == len(slower)
    assert abs(got["mean_increase_pct"] - np.mean(slower)) < 1e-4 and abs(got["p75_increase_pct"] - np.quantile(slower, 0.75)) < 1e-4
    assert got["n_severe"] == sum(x >= 50 for x in slower)


def test_country_rows_equal_the_driver_on_each_country_alone(spark):
    rng = random.Random(11)
    rows = []
    for country in (1, 2, 3):
        rows += [(f"{country}-{u}-{v}", country, u, v, float(rng.randint(1, 9)), "unpaved" if (u + v) % 5 else "paved") for u in range(1, 7) for v in range(100, 105) if rng.random() < 0.5]
        rows += [(f"{country}-far{u}", country, u, 150, 2.0, "Unpaved") for u in (50, 51)]
    rows += [("4-a", 4, 1, 100, 3.0, "unpaved"), ("4-b", 4, 1, 101, 3.0, "unpaved"), ("5-a", 5, 1, 100, 3.0, None)]  # three nodes; nothing unpaved
    rows = [(r, c, u, v, w, s, w, w * (1 + (u % 3) / 2)) for r, c, u, v, w, s in rows]
    frame = spark.createDataFrame(rows, "road_id string, country_id long, u long, v long, length_km double, surface string, w0 double, w1 double")
    got = {r["country_id"]: r.asDict() for r in networks.country_rows(frame).collect()}
    assert set(got) == {1, 2, 3}
    for country, row in got.items():
        alone = networks.country_driver(frame.filter(F.col("country_id") == country)).first().asDict()
        assert {k: row[k] for k in alone} == alone
    assert networks.country_rows(frame.limit(0)).count() == 0


def test_grouped_quantiles_equal_interpolated_ones(spark):
    rng = random.Random(13)
    rows = [(rng.choice("aaab"), float(rng.randint(0, 9)) if rng.random() < 0.8 else None) for _ in range(300)] + [("c", None), ("d", 4.0)]
    got = {r["k"]: (r["q_0"], r["q_1"]) for r in grouped_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(5), ["k"], "x", (0.5, 0.75)).collect()}
    assert set(got) == {"a", "b", "d"}
    for k, cuts in got.items():
        assert np.allclose(cuts, np.quantile([x for g, x in rows if g == k and x is not None], (0.5, 0.75)))


def test_district_rollup_by_hand(spark):
    rows = [(1, 1, 10, 20, 0.8, 0.1, 2, 4.0, 0.1, 1.0, 0.9, 5.0, 6.0, 1, 0.2, 0.5), (1, 2, 30, 40, 0.6, 0.3, 1, 8.0, 0.3, 2.0, 1.0, 7.0, 9.0, 4, None, 0.1), (1, 3, 20, 10, 1.0, 0.2, 0, 0.0, 0.2, 0.0, 0.0, 1.0, 1.0, 0, 0.4, None)]
    names = "country_id long, district_id long, n_nodes long, n_edges long, lcc_ratio double, bridge_ratio double, n_critical int, road_drop double, p_block double, e_normal double, e_extreme double, d_normal double, d_extreme double, new_parts int, q_c double, fall_at_q_c double"
    (r,) = district_rollup(spark.createDataFrame(rows, names), "country_id").collect()
    assert len(r) == 26  # the key and 25 figures
    assert (r["n_districts"], r["critical_total"], r["new_parts_max"], r["nodes_median"], r["edges_median"]) == (3, 3, 4, 20.0, 20.0)
    assert (r["loss_pct_mean"], r["loss_pct_q75"], r["amp_mean"], r["amp_over_1_pct"]) == (30.0, 40.0, 4.375, 66.66667)
    assert (r["road_deg_mean"], r["road_deg_std"], r["q_c_mean"], r["q_c_median"], r["fall_at_q_c_mean"]) == (4.0, 4.0, 0.3, 0.3, 0.3)
