"""Health variants on small countries, and nearest rows within a key, against plain loops."""

import math

import pytest

from netaccess.operators import variants as V
from netaccess.operators.spatial import k_nearest, nearest

NODES = "node_id long, country_id long, x double, y double, t_normal double, t_extreme double"
SITES = "site_id long, country_id long, x double, y double, text string"
PEOPLE = "pixel_id long, country_id long, x double, y double, weight long"


def test_nearest_stays_within_its_key(spark):
    left = spark.createDataFrame([(i, i % 3, float(i * 7 % 50), float(i * 11 % 50)) for i in range(30)], "a long, g int, x double, y double")
    right = spark.createDataFrame([(i, i % 2, float(i * 13 % 50), float(i * 5 % 50)) for i in range(20)], "b long, g int, x double, y double")
    ls, rs = left.collect(), right.collect()
    order = lambda l: sorted(((l.x - r.x) ** 2 + (l.y - r.y) ** 2, r.b) for r in rs if r.g == l.g)
    assert {(r.a, r.b, r.d2) for r in nearest(left, "a", right, "b", "x", "y", by="g").collect()} == {(l.a, order(l)[0][1], order(l)[0][0]) for l in ls if order(l)}
    assert {(r.a, r.b, r["rank"]) for r in k_nearest(left, "a", right, "b", "x", "y", 3, by="g").collect()} == {(l.a, b, i) for l in ls for i, (_, b) in enumerate(order(l)[:3], 1)}


def plain(nodes, sites, people, name, limit):
    """The figures of a variant by nearest nodes, from loops over one country."""
    near = lambda p: min((math.dist(p, n[2:4]), n[0]) for n in nodes)
    where = {n[0]: n[2:4] for n in nodes}

    def anchors(which, reach):
        return {where[near(s[2:4])[1]] for s in sites if any(w in s[4] for w in V.FACILITY_SETS[which]) and near(s[2:4])[0] <= reach}

    own, usual = anchors(name, limit), anchors(V.DEFAULT_SET, V.DEFAULT_KM)
    way = lambda n, a: min((math.dist(n[2:4], p) for p in a), default=math.inf)
    weight = {}
    for p in people:
        d, node = near(p[2:4])
        if d <= limit:
            weight[node] = weight.get(node, 0) + p[4]
    more = lambda n: way(n, own) - way(n, usual) if own and usual else 0.0
    rows = [(max(0, n[4] + more(n) / 40), max(0, n[5] + more(n) / 30), weight[n[0]]) for n in nodes if n[0] in weight]
    if not own or not rows:
        return None
    return sum(w for a, _, w in rows if a <= 1), sum(w for _, b, w in rows if b <= 1), sum((b - a) * w for a, b, w in rows) / sum(w for *_, w in rows)


def test_variants_equal_plain_loops(spark):
    nodes = [(i, 1, float(i * 37 % 100), float(i * 53 % 97), i * 0.11 % 1.4, i * 0.11 % 1.4 + i % 4 * 0.2) for i in range(1, 16)]
    sites = [(i, 1, float(i * 29 % 120), float(i * 43 % 110), ("hospital", "old clinic", "pharmacy", "school")[i % 4]) for i in range(12)]
    people = [(i, 1, float(i * 17 % 130), float(i * 23 % 125), i * 3 % 11) for i in range(40)]
    odd = [(90, 1, 5.0, 5.0, None, 1.0)]  # no time: not a node
    out = V.health_variants(spark.createDataFrame(nodes + odd, NODES), spark.createDataFrame([*sites, (99, 2, 1.0, 1.0, "hospital"), (98, 1, 2.0, 2.0, None)], SITES), spark.createDataFrame(people, PEOPLE), 1.0).collect()
    assert len(out) == 18 and {r.country_id for r in out} == {1}
    for r in out:
        if r.mapping == "nearest_node":
            want = plain(nodes, sites, people, r.facility_set, r.threshold_km)
            assert (r.normal_covered_1h, r.extreme_covered_1h) == want[:2] and r.pwmtt_delta == pytest.approx(want[2], abs=2e-6)


def test_variants_without_sites_or_people(spark):
    nodes = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.7)], NODES)
    far = spark.createDataFrame([(1, 1, 900.0, 0.0, "hospital")], SITES)
    none = spark.createDataFrame([], PEOPLE)
    assert V.health_variants(nodes, far.limit(0), none, 1.0).count() == 0
    rows = V.health_variants(nodes, far, none, 1.0).collect()
    assert len(rows) == 18 and {r.status for r in rows} == {"no_anchors_or_population"} and {r.pwmtt_delta for r in rows} == {None}


def test_variants_broadcast_countries_only(spark, monkeypatch):
    """Their files are small and their rows are not: no table of variants may pass through the driver."""
    plans, plain = [], V.materialize

    def noted(df, tag, **options):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, tag, **options)

    monkeypatch.setattr(V, "materialize", noted)
    from netaccess.plans import registry

    assert registry.QUERIES["ac8_health_variants"](spark, "/root/testdata/sf0.001").count() > 0
    # countries, counted before they are broadcast, are the right side of a semi-join
    assert [tag for tag, plan in plans if plan.count("BroadcastHashJoin") > plan.count("LeftSemi, BuildRight")] == []
    assert any(tag == "variants" and "SortMergeJoin" in plan for tag, plan in plans)
