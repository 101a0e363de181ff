"""Searches, fits, names, measures and merged nets against plain Python."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from netaccess.functions.rules import folded_name
from netaccess.graph.build import merge_countries
from netaccess.operators import measures, spatial, statistics
from netaccess.operators.joining import name_matches
from netaccess.operators.sensitivity import PARAMETERS, trajectories
from netaccess.operators.stability import grouped_median


@pytest.mark.parametrize("seed", range(2))
def test_k_nearest_at_any_distance(spark, seed):
    r = random.Random(seed)
    points = [(i, float(r.choice([r.randrange(20), r.randrange(5_000)])), float(r.randrange(30))) for i in range(60)] + [(100, 0.0, 0.0), (101, 0.0, 0.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {(x["id"], x["rank"]): (x["neighbour"], x["d2"]) for x in spatial.k_nearest(df, "id", df, "id", "x", "y", 4, itself=False).collect()}
    assert len(got) == 4 * len(points)
    for i, x, y in points:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in points if j != i)[:4]
        assert [got[i, k] for k in (1, 2, 3, 4)] == [(j, d) for d, j in near]


def test_k_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0)], "id long, x double, y double")
    assert len(spatial.k_nearest(df, "id", df, "id", "x", "y", 4, itself=False).collect()) == 2
    assert spatial.k_nearest(df.limit(0), "id", df, "id", "x", "y", 4).count() == 0


def test_boxes_meet_once(spark):
    r = random.Random(3)
    box = lambda i: (i, *(lambda a, b: (a, a + r.randrange(60), b, b + r.randrange(25)))(r.randrange(-100, 300), r.randrange(-50, 200)))
    left, right = [box(i) for i in range(80)] + [(900, 5, 4, 0, 1)], [box(i) for i in range(70)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x0 long, x1 long, y0 long, y1 long")
    got = [(a, b) for a, b in spatial.boxes_meet(frame(left), frame(right), 16.0).select("l.id", "r.id").collect()]
    want = [(a, b) for a, p, q, s, t in left[:-1] for b, w, x, y, z in right if p <= x and w <= q and s <= z and y <= t]
    assert sorted(got) == sorted(want)


def test_nearest_on_an_irregular_axis(spark):
    r = random.Random(4)
    axis = [float(r.randrange(1_000)) for _ in range(40)]
    values = [float(r.randrange(-50, 1_100)) for _ in range(300)] + [None, axis[0], (axis[0] + axis[1]) / 2]
    got = spatial.nearest_on_axis(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double"), "v", spark.createDataFrame([(a,) for a in axis], "a double"), "a", "cell").collect()
    for row in got:
        v = values[row["i"]]
        assert row["cell"] == (None if v is None else min(axis, key=lambda a: (abs(a - v), a)))


def test_plane_fits_and_p_values(spark):
    r = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", float(x), float(z), float(1 + 2 * x - 0.5 * z + e)) for i, (x, z, e) in enumerate(r.normal(size=(90, 3)))] + [("c", 1.0, 2.0, 3.0), ("b", None, 1.0, 1.0)]
    got = {x["g"]: x for x in statistics.plane_fits(spark.createDataFrame(rows, "g string, x double, z double, y double"), ["g"], "x", "z", "y").withColumn("p", statistics.two_sided_p("t2", (F.col("n") - 3).cast("double"))).collect()}
    assert set(got) == {"a", "b"}
    for g, row in got.items():
        own = np.array([v[1:] for v in rows if v[0] == g and None not in v])
        x, y = np.column_stack([np.ones(len(own)), own[:, 0], own[:, 1]]), own[:, 2]
        beta = np.linalg.solve(x.T @ x, x.T @ y)
        rest = y - x @ beta
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (rest @ rest) / (len(y) - 3))
        assert np.allclose([row[f"b{k}"] for k in range(3)], beta) and np.allclose([row[f"se{k}"] for k in range(3)], se)
        assert row["r2"] == pytest.approx(1 - rest @ rest / ((y - y.mean()) ** 2).sum())
        df, t = len(y) - 3, abs(row["t2"])
        grid = np.linspace(t, t + 400, 2_000_001)
        density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
        assert row["p"] == pytest.approx(2 * np.trapezoid(density, grid), abs=1e-6)


def test_clusters_take_the_cheapest_start(spark):
    r = np.random.default_rng(6)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0], [8, 8, 8]])
    points = [(i, [float(v) for v in centres[i % 4 if i < 40 else 0] + r.normal(size=3) * 0.3] + [5.0]) for i in range(60)]
    scaled = statistics.standardised(spark.createDataFrame(points, "id long, v array<double>"), "v", 4)
    raw = np.array([p[1] for p in points])
    std = raw.std(0)
    assert np.allclose([x["v"] for x in scaled.orderBy("id").collect()], np.where(std > 0, (raw - raw.mean(0)) / np.where(std > 0, std, 1), 0))
    labels, cost = statistics.clusters(scaled, "id", "v", 4, restarts=5)
    got = dict(labels.collect())
    assert [got[i] == got[j] for i in range(60) for j in range(60)] == [(i % 4 if i < 40 else 0) == (j % 4 if j < 40 else 0) for i in range(60) for j in range(60)]
    assert got[0] == 0  # the largest
    z = np.where(std > 0, (raw - raw.mean(0)) / np.where(std > 0, std, 1), 0)
    assert cost == pytest.approx(sum(((z[[i for i in got if got[i] == c]] - z[[i for i in got if got[i] == c]].mean(0)) ** 2).sum() for c in set(got.values())))


def test_names_lose_their_marks(spark):
    names = ["São-Tomé", "N'Djamena", "  Łódź  x ", "Ångström", "ﬁn", "Straße", "漢 a", None, "Ｗide"]
    got = [x[0] for x in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").orderBy("i").select(folded_name(F.col("n"))).collect()]
    plain = lambda n: None if n is None else " ".join(unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower().replace("'", "").replace("-", " ").split())
    assert [g for i, g in enumerate(got) if i != 4] == [plain(n) for i, n in enumerate(names) if i != 4]


def test_name_matches_rank_and_pass_on(spark):
    left = spark.createDataFrame([(1, 1, "Évora"), (2, 1, "Lagos"), (3, 2, "Évora"), (4, 1, "Nowhere"), (5, 1, None)], "k long, iso long, name string")
    right = spark.createDataFrame([(10, 1, "EVORA", None, 5.0, 1.0, 2.0), (11, 1, "x", "evora", 9.0, 3.0, 4.0), (12, 1, "Evora", None, 9.0, 5.0, 6.0), (13, 2, "y", "Beja", 1.0, 7.0, 8.0)], "id long, iso long, name string, ascii_name string, pop double, lon double, lat double")
    got = {x["k"]: (x["matched_by"], x["id"], x["lon"]) for x in name_matches(left, right, "k", [F.col("pop")], {"Lagos": (3.5, 6.5)}).collect()}
    assert got == {1: ("name", 11, 3.0), 2: ("override", None, 3.5), 3: ("missing", None, None), 4: ("missing", None, None), 5: ("missing", None, None)}


def test_inequality_bundle_repeats_rows(spark):
    r = random.Random(8)
    rows = [("ab"[i % 2], r.choice([1.0, 2.0, 2.5, r.random() * 9]), r.choice([0.5, 1.0, 3.0]), r.choice([10.0, 25.0, 47.0, 9_000.0])) for i in range(60)] + [("c", 1.0, 1.0, 5.0), ("a", None, 1.0, 5.0)]
    df = spark.createDataFrame([(g, t, None if t is None else t + d, w) for g, t, d, w in rows], "g string, t0 double, t1 double, w double")
    got = {x["g"]: x for x in measures.inequality_bundle(df, "g", "t0", "t1", "w").collect()}
    assert got["c"]["gini_normal"] is None
    for g in "ab":
        own = [(t, d, w) for h, t, d, w in rows if h == g and t is not None]
        least = min(w for *_, w in own)
        times = [int(min(500, max(1, round(w / least)))) for *_, w in own]
        t = np.repeat([x for x, *_ in own], times)
        gini = lambda v: (lambda s: 2 * (np.arange(1, len(s) + 1) * s).sum() / (len(s) * s.sum()) - (len(s) + 1) / len(s))(np.sort(v))
        assert got[g]["gini_normal"] == pytest.approx(gini(t)) and got[g]["gini_extreme"] == pytest.approx(gini(np.repeat([x + d for x, d, _ in own], times)))
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        delay = np.repeat([(x + d) - x for x, d, _ in own], times)
        assert got[g]["spearman_rho"] == pytest.approx(np.corrcoef(rank(t), rank(delay))[0, 1])
        by = sorted(((x + d) - x, w) for x, d, w in own)
        upto = np.cumsum([w for _, w in by]) / sum(w for _, w in by)
        assert got[g]["p90_delta"] == by[int(np.searchsorted(upto, 0.9 - 1e-12))][0]


def test_grouped_median(spark):
    rows = [(g, i, v) for g, values in (("a", [1.0, 5.0, 2.0]), ("b", [4.0, 1.0, 9.0, None, 2.0]), ("c", [None])) for i, v in enumerate(values)]
    got = dict(grouped_median(spark.createDataFrame(rows, "g string, i long, v double"), ["g"], "v", "i", "m").collect())
    assert got == {"a": 2.0, "b": 3.0}


def test_merged_countries(spark):
    edges = [("a", 5, 7, 1.0, 2.0), ("a", 7, 5, 0.5, 3.0), ("b", 5, 9, 1.0, 1.0), ("b", 9, 11, 1.0, 1.5)]
    nodes = [("a", 5, 0.0, 0.0), ("a", 7, 50.0, 0.0), ("b", 5, 53.0, 4.0), ("b", 9, 90.0, 50.0), ("b", 11, 100.0, 100.0)]
    numbered, merged = merge_countries(spark.createDataFrame(edges, "country string, u long, v long, w0 double, w1 double"), spark.createDataFrame(nodes, "country string, node long, x double, y double"), 10.0, 6.0, 0.1)
    assert {(x["country"], x["node"]): x["id"] for x in numbered.collect()} == {("a", 5): 0, ("a", 7): 1, ("b", 5): 2, ("b", 9): 3, ("b", 11): 4}
    assert sorted(tuple(x) for x in merged.collect()) == [(0, 1, 0.5, 3.0, False), (1, 2, 0.5, 0.5, True), (2, 3, 1.0, 1.0, False), (3, 4, 1.0, 1.5, False)]


def test_trajectories_move_each_parameter_once():
    rows = trajectories()
    assert len(rows) == 20 * 9
    for t in range(20):
        own = [r for r in rows if r[1] == t]
        assert sorted(r[3] for r in own[1:]) == sorted(PARAMETERS)
        for a, b in zip(own, own[1:]):
            moved = [p for p, x, y in zip(PARAMETERS, a[5:], b[5:]) if x != y]
            assert moved == [b[3]]
