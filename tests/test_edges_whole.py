"""The queries over ``edges_s`` see every order and line: against brute force on a small fixture."""

import random

import pytest

from netaccess.plans import registry

PARTS = 10_000_000


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Folder and edges of a sparse graph; most orders are no multiple of 8 and most lines are not the first."""
    r = random.Random(3)
    path = tmp_path_factory.mktemp("edges")
    orders = [(o, r.randrange(14)) for o in range(1, 23)]
    lines = [(o, n, r.randrange(30), float(r.randrange(1, 50)), 0.02 * r.randrange(5)) for o, _ in orders for n in range(1, r.randrange(2, 4))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_quantity double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    customer = dict(orders)
    return str(path), {(customer[o], PARTS + p) for o, _, p, _, _ in lines}


def components(edges):
    label = {x: x for e in edges for x in e}
    while moved := [(u, v) for u, v in edges if label[u] != label[v]]:
        for u, v in moved:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_components_of_all_lines(spark, small):
    path, edges = small
    want = components(edges)
    assert {r["node"]: r["component"] for r in registry.QUERIES["gr5_components"](spark, path).collect()} == want
    sizes = sorted((list(want.values()).count(c), -c) for c in set(want.values()))
    row = registry.QUERIES["gr5_largest_component"](spark, path).first()
    assert (row["component"], row["n_nodes"], row["n_components"]) == (-sizes[-1][1], sizes[-1][0], len(sizes))


def test_bridges_of_all_lines(spark, small):
    path, edges = small
    parts = lambda e: len(set(components(e).values())) + len({x for pair in edges for x in pair} - {x for pair in e for x in pair})
    want = {e for e in edges if parts(edges - {e}) > parts(edges)}
    assert want and want != edges
    assert {(r["u"], r["v"]) for r in registry.QUERIES["gr12_bridges"](spark, path).collect()} == want


def test_loads_and_semi_nodes_of_all_lines(spark, small):
    path, edges = small
    ends = [x for e in edges for x in e]
    want = {(u, v) for u, v in edges if ends.count(u) >= 2 and ends.count(v) >= 2}
    assert {(r["u"], r["v"]) for r in registry.QUERIES["jn18_semi_nodes"](spark, path).collect()} == want
    # every node is a source, so that the loads sum to the distances in steps of all pairs, and a bridge carries all pairs it parts
    loads = {(r["u"], r["v"]): r["load"] for r in registry.QUERIES["gr13_edge_betweenness"](spark, path).collect()}
    label, nodes = components(edges), set(ends)
    n = len(nodes)
    assert set(loads) <= edges
    for bridge in registry.QUERIES["gr12_bridges"](spark, path).collect():
        e = (bridge["u"], bridge["v"])
        cut = components(edges - {e})
        side = sum(1 for x in nodes if label[x] == label[e[0]] and cut.get(x, x) == cut.get(e[0], e[0]))
        other = sum(1 for x in nodes if label[x] == label[e[0]]) - side
        assert loads[e] == pytest.approx(2 * side * other / (n * (n - 1)), abs=1e-8)
