"""Column rules, measures, spatial joins, ranks, sources and sinks on small fixtures."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from netaccess.functions import rules as R
from netaccess.operators import joining as J
from netaccess.operators import measures as M
from netaccess.operators import ranking as K
from netaccess.operators import sets as S
from netaccess.operators import spatial as X
from netaccess.operators import statistics as T
from netaccess.operators.climate import passability
from netaccess.sources import sinks, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_roughness_and_speed(spark):
    row = one(spark, R.roughness(F.lit(10.0), F.lit(2.0), F.lit(0.05)).alias("iri"), R.roughness_speed(F.lit(7.0)).alias("mid"), R.roughness_speed(F.lit(99.0)).alias("end"))
    assert row["iri"] == pytest.approx(6.0294591352, abs=1e-9)
    assert row["mid"] == 93.0 and row["end"] == 32.0


def test_passability(spark):
    got = passability(spark.createDataFrame([(1, float(m)) for m in (1, 2, 3, 4, 10)], "cell_id long, mrso double")).first()
    assert (got["p75"], got["p95"], got["pass_normal"]) == (4, pytest.approx(8.8), 0.8)
    assert got["pass_extreme"] == pytest.approx(0.363636, abs=1e-6)


def test_connection_types(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (None, 1.0), (None, None), (0.0, 0.0)], "t0 double, t1 double")
    rows = df.select(R.connection_type(F.col("t0"), F.col("t1")).alias("k"), R.pct_increase(F.col("t0"), F.col("t1")).alias("i")).withColumn("s", R.severe(F.col("i"))).collect()
    assert [tuple(r) for r in rows] == [("connected", 100.0, 1), ("climate_disconnected", None, 0), ("normal_unreachable", None, 0), ("both_unreachable", None, 0), ("connected", None, 0)]


def test_weighted_statistics_and_gini(spark):
    df = spark.createDataFrame([(1, i, t, w) for i, (t, w) in enumerate(((0.5, 10.0), (1.0, 20.0), (2.0, 30.0), (4.0, 40.0)))], "k long, id long, t double, w double")
    got = M.weighted_stats(df, ["k"], "t", "w", "id", (0.1, 0.5, 0.9)).first()
    assert (got["mean"], got["p10"], got["p50"], got["p90"]) == (2.45, 0.5, 2.0, 4.0)
    assert M.gini(spark.createDataFrame([(1, i, float(i)) for i in (1, 2, 3, 4)], "k long, id long, x double"), ["k"], "x", "id").first()["gini"] == 0.25


def test_global_ranks(spark):
    random.seed(1)
    values = [random.randrange(50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x long").repartition(7)
    ranked = {r["id"]: r["rank"] for r in K.global_rank(df, [F.desc("x"), F.asc("id")]).collect()}
    order = sorted(range(500), key=lambda i: (-values[i], i))
    assert [ranked[i] for i in order] == list(range(1, 501))
    averages = {r["id"]: r["avg_rank"] for r in K.value_ranks(df, "x").collect()}
    assert all(averages[i] == sum(v < values[i] for v in values) + (values.count(values[i]) + 1) / 2 for i in range(500))


def test_spearman_matches_formula(spark):
    random.seed(2)
    rows = [(float(random.randrange(20)), float(random.randrange(20))) for _ in range(200)]
    got = T.spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()

    def ranks(v):
        return [sum(x < y for x in v) + (v.count(y) + 1) / 2 for y in v]

    a, b = ranks([r[0] for r in rows]), ranks([r[1] for r in rows])
    ma, mb = sum(a) / 200, sum(b) / 200
    rho = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
    assert got["rho"] == pytest.approx(rho) and got["n"] == 200


def test_t_p_values():
    assert T.t_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert T.t_p_value(0.0, 5) == pytest.approx(1.0)


def test_spatial_joins_match_brute_force(spark):
    random.seed(3)
    a = [(i, float(random.randrange(300)), float(random.randrange(300))) for i in range(120)]
    b = [(i, float(random.randrange(300)), float(random.randrange(300))) for i in range(80)]
    left, right = spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "j long, x double, y double")
    d2 = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    near = {(r["i"], r["j"]) for r in X.within(left, right, "x", "y", 25.0).select("i", "j").collect()}
    assert near == {(p[0], q[0]) for p in a for q in b if d2(p, q) <= 625}
    got = {r["i"]: (r["d2"], r["j"]) for r in X.nearest(left, "i", right, "j", "x", "y", 60.0, 10.0).collect()}
    best = {p[0]: min((d2(p, q), q[0]) for q in b) for p in a}
    assert got == {i: m for i, m in best.items() if m[0] <= 3600}


def test_no_nested_loop_in_spatial_join(spark):
    p = spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    plan = X.within(p, p, "x", "y", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_point_in_triangle(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (0, 10), (0, 0))))
    row = one(spark, X.point_in_ring(F.lit(2.0), F.lit(2.0), ring).alias("a"), X.point_in_ring(F.lit(8.0), F.lit(8.0), ring).alias("b"))
    assert (row["a"], row["b"]) == (True, False)


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(Exception, match="repeated key"):
        J.one_to_one(a, spark.createDataFrame([(1, 2)], "k long, w long"), ["k"]).collect()


def test_jaccard_of_empty_sets_is_one(spark):
    empty = spark.createDataFrame([], "k long")
    assert S.jaccard(empty, empty, ["k"]).first()["jaccard"] == 1.0


def test_files(spark, tmp_path):
    (tmp_path / "Kenya_road_speed.csv").write_text("road_id,v\na,1.5\nb,x\n")
    (tmp_path / "Mali_road_speed.csv").write_text("road_id,v\nc,2.5\n")
    df = tables.read_glob(spark, f"{tmp_path}/*_road_speed.csv", "road_id string, v double").withColumn("country", tables.country_of_file(F.col("file"), "_road_speed.csv"))
    assert {(r["country"], r["road_id"], r["v"]) for r in df.collect()} == {("Kenya", "a", 1.5), ("Kenya", "b", None), ("Mali", "c", 2.5)}
    countries = spark.createDataFrame([("Kenya",), ("Togo",)], "country string")
    assert [r["country"] for r in tables.missing_countries(df, countries).collect()] == ["Togo"]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.require_columns(df, ["v", "z"])
    sinks.write_groups(df, f"{tmp_path}/out", ["country"], least=2)
    assert {r["country"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"Kenya"}


def test_climate_names_and_raster(spark):
    names = spark.createDataFrame([Row(file="pr_AFR-44_M1_rcp85_r1i1p1_RCA4_v1_mon_204101-205012.nc"), Row(file="notes.txt")])
    got = tables.climate_inventory(names).collect()
    assert [(r["var"], r["gcm"], r["rcp"], r["freq"], r["first_year"], r["last_year"]) for r in got] == [("pr", "M1", "rcp85", "mon", 2041, 2050)]
    raster = spark.createDataFrame([(0, 0, 5.0), (0, 1, -99.0), (1, 0, 2.0), (3, 3, -1.0)], "row long, col long, pop double")
    assert [tuple(r) for r in tables.positive_pixels(raster, -99.0, 10.0, 50.0, 1.0, block=2).collect()] == [(11.0, 49.0, 7.0)]
