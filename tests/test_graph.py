"""Graph operators against hand-made graphs and brute force."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netaccess.graph import build as B
from netaccess.graph import paths as P
from netaccess.graph import structure as G
from netaccess.graph.components import connected_components
from netaccess.operators import access as A

F1 = [(1, 2, 1.0, 2.0), (2, 3, 1.0, 1.5), (1, 3, 3.0, 3.0), (3, 4, 2.0, 4.0), (4, 5, 1.0, 1.0), (4, 6, 1.0, 3.0), (5, 6, 1.0, 1.0)]


@pytest.fixture(scope="module")
def f1(spark):
    return spark.createDataFrame(F1, "u long, v long, w0 double, w1 double")


def floyd(edges, weight):
    nodes = sorted({x for e in edges for x in e[:2]})
    d = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for u, v, *w in edges:
        d[u, v] = d[v, u] = min(d[u, v], w[weight])
    for k, a, b in itertools.product(nodes, nodes, nodes):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


def test_distances_from_one(spark, f1):
    start = spark.createDataFrame([(1, 1)], "src long, node long")
    for weight, expected in (("w0", [0, 1, 2, 4, 5, 5]), ("w1", [0, 2, 3, 7, 8, 9])):
        got = {r["node"]: r["dist"] for r in P.shortest_paths(B.both_ways(f1, weight), start).collect()}
        assert [got[k] for k in range(1, 7)] == expected


def test_bridges(f1):
    assert {(r["u"], r["v"]) for r in G.bridges(f1).collect()} == {(3, 4)}


def test_bridges_and_components_match_brute_force(spark):
    random.seed(5)
    pairs = sorted({tuple(sorted(random.sample(range(40), 2))) for _ in range(44)})

    def parts(edges):
        label = {x: x for e in pairs for x in e}
        for _ in range(len(label)):
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        return label

    edges = spark.createDataFrame(pairs, "u long, v long")
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == parts(pairs)
    expected = {e for e in pairs if len(set(parts([x for x in pairs if x != e]).values())) > len(set(parts(pairs).values()))}
    assert {(r["u"], r["v"]) for r in G.bridges(edges).collect()} == expected


def test_edge_loads_sum_distances_in_hops(spark, f1):
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "node long")
    loads = {(r["u"], r["v"]): r["load"] for r in G.edge_loads(f1.withColumn("w0", F.lit(1.0)), nodes, "w0", F.lit(1.0)).collect()}
    hops = floyd([(u, v, 1.0) for u, v, *_ in F1], 0)
    assert sum(loads.values()) == sum(hops.values())
    assert loads[3, 4] == 18  # every path between the two halves, both ways


def test_forced_path_and_buffering(spark):
    facility = spark.createDataFrame([(1,)], "facility_id long")
    edges = spark.createDataFrame([(u + 1_000_000, v + 1_000_000, a, b) for u, v, a, b in F1], "u long, v long, w0 double, w1 double")
    got = {r["node"] - 1_000_000: (r["direct_degradation"], round(r["buffering_ratio"], 4)) for r in A.buffering(edges, facility).collect()}
    assert got[3] == (1.5, 0.3333)
    assert got[6] == (5.5, 0.2727)
    assert all(0 <= ratio <= 1 for _, ratio in got.values())


def test_components_of_empty_and_loops(spark):
    empty = spark.createDataFrame([], "u long, v long")
    assert connected_components(empty).count() == 0
    loop = spark.createDataFrame([(7, 7), (1, 2)], "u long, v long")
    assert {r["node"]: r["component"] for r in connected_components(loop).collect()} == {7: 7, 1: 1, 2: 1}


def test_percolation_is_non_increasing(spark, f1):
    rows = G.percolation(f1.withColumn("district", F.lit(1)), F.col("w1"), 5).orderBy("step").collect()
    shares = [r["share"] for r in rows]
    assert shares[0] == 1.0 and all(a >= b for a, b in zip(shares, shares[1:]))


def test_parallel_edges_keep_least_w0(spark):
    rows = spark.createDataFrame([(1, 2, 3.0, 9.0, "a"), (2, 1, 2.0, 8.0, "b"), (1, 1, 0.1, 0.1, "c")], "u long, v long, w0 double, w1 double, road_id string")
    assert [tuple(r) for r in B.simple_edges(rows).collect()] == [(1, 2, 2.0, 8.0, "b")]


def random_graph(seed, nodes=12, edges=22):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample(range(nodes), 2))) for _ in range(edges)})
    return [(u, v, float(r.randrange(1, 4))) for u, v in pairs]


def shortest(edges, s, t):
    """Every shortest path from s to t as a list of edges, by trying all simple paths."""
    best, found, todo = float("inf"), [], [(0.0, s, [], {s})]
    while todo:
        d, at, steps, seen = todo.pop()
        if at == t:
            if d < best:
                best, found = d, []
            if d == best:
                found.append(steps)
            continue
        for u, v, w in edges:
            if at in (u, v) and d + w <= best:
                to = v if at == u else u
                if to not in seen:
                    todo.append((d + w, to, steps + [(u, v)], seen | {to}))
    return best, found


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_splits_ties_as_brute_force(spark, seed):
    edges = random_graph(seed, 9, 16)
    nodes = sorted({x for e in edges for x in e[:2]})
    got = {(r["u"], r["v"]): r["load"] for r in G.edge_betweenness(spark.createDataFrame(edges, "u long, v long, w double"), "w", sample=5).collect()}
    want = {}
    for s, t in itertools.product(nodes[:5], nodes):
        if s != t:
            _, paths = shortest(edges, s, t)
            for path in paths:
                for e in path:
                    want[e] = want.get(e, 0) + 1 / len(paths)
    assert got == pytest.approx({e: x / (5 * (len(nodes) - 1)) for e, x in want.items()})


def test_gravity_loads_as_brute_force(spark):
    edges = [(u, v, w + i / 1000) for i, (u, v, w) in enumerate(random_graph(4, 9, 14))]  # no ties
    people = [(0, 10.0), (3, 5.0), (5, 2.0), (7, 0.0), (99, 4.0)]
    got = {(r["u"], r["v"]): r["load"] for r in G.gravity_loads(spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame(people, "node long, pop double"), "w").collect()}
    want = {}
    for (s, p), (t, q) in itertools.combinations(people, 2):
        d, paths = shortest(edges, s, t)
        for e in paths[0] if paths else []:
            want[e] = want.get(e, 0) + p * q / d**2
    assert got == pytest.approx({e: x for e, x in want.items() if x > 0})


@pytest.mark.parametrize("sample", [300, 4])
def test_metrics_as_brute_force(spark, sample):
    nets = {0: random_graph(7, 14, 16), 1: random_graph(8, 10, 9), 2: [(1, 1, 1.0)]}
    rows = [(k, *e) for k, edges in nets.items() for e in edges] + [(0, 0, 50, None)]
    got = {r["net"]: r for r in G.network_metrics(spark.createDataFrame(rows, "net int, u long, v long, w double"), sample, 2).collect()}
    assert set(got) == set(nets)
    for k, edges in nets.items():
        d = floyd(edges, 0)
        nodes = sorted({x for e in edges for x in e[:2]})
        parts = {min(b for b in nodes if d[a, b] < float("inf")) for a in nodes}
        lcc = max(([b for b in nodes if d[p, b] < float("inf")] for p in sorted(parts)), key=len)
        assert (got[k]["n_nodes"], got[k]["n_components"]) == (len(nodes), len(parts))
        assert got[k]["lcc_ratio"] == pytest.approx(len(lcc) / len(nodes))
        first = lcc[:sample]
        inverse = sum(1 / d[a, b] for a in first for b in lcc if d[a, b] > 0)
        assert got[k]["efficiency"] == pytest.approx(inverse / (len(first) * (len(lcc) - 1)) if len(lcc) > 1 else 0)
        assert got[k]["diameter"] == pytest.approx(max(d[a, b] for a in (lcc if len(lcc) <= sample else lcc[:2]) for b in lcc))


def test_metrics_of_no_edges(spark):
    assert G.network_metrics(spark.createDataFrame([], "net int, u long, v long, w double")).count() == 0


def test_inverse_hops_as_brute_force():
    edges = [(u, v, 1.0) for u, v, _ in random_graph(3, 12, 15)]
    d = floyd(edges, 0)
    got = G.inverse_hops(pd.DataFrame({"district": 1, "step": 0, "i": [u for u, *_ in edges], "j": [v for _, v, _ in edges]}))
    assert got["inverse"][0] == pytest.approx(sum(1 / x for x in d.values() if 0 < x < float("inf")))


def test_percolation_curve_and_tipping_point_of_two_districts(spark):
    """A path of 30 nodes cut in the middle first, beside a star of 25 whose edges all tie."""
    path = [(1, k, k + 1, 2.0 if k == 14 else 1.0) for k in range(29)]
    star = [(2, 0, k, 1.0) for k in range(1, 25)]
    edges = spark.createDataFrame(path + star, "district int, u long, v long, s double")
    rows = {(r["district"], r["step"]): r for r in G.percolation(edges, F.col("s"), 5, 6).collect()}
    assert len(rows) == 12
    assert rows[1, 0]["share"] == rows[2, 0]["share"] == 1.0
    whole = sum(1 / abs(a - b) for a in range(30) for b in range(30) if a != b)
    assert rows[1, 0]["efficiency"] == pytest.approx(whole / (30 * 29))
    assert rows[2, 0]["efficiency"] == pytest.approx((2 * 24 + 24 * 23 / 2) / (25 * 24))
    assert rows[2, 1]["share"] == pytest.approx(21 / 25) and rows[2, 2]["efficiency"] == 0  # 4 leaves go a step; parts of under 20 nodes count 0
    for d in (1, 2):
        assert all(rows[d, k]["share"] >= rows[d, k + 1]["share"] and rows[d, k]["efficiency"] >= rows[d, k + 1]["efficiency"] for k in range(5))
    tip = {r["district"]: r for r in G.tipping_point(G.percolation(edges, F.col("s"), 5, 6), 5).collect()}
    assert tip[1]["q_c"] == 0 and tip[1]["amplification"] is None
