"""Climate to road speed: per-cell statistics joined to roads, then column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess import config as C
from netaccess.functions import rules as R


def passability(climate: DataFrame, value: str = "mrso") -> DataFrame:
    """Passable share of months per cell: at or under the 75th percentile; extreme scales it by P75 / P95."""
    from netaccess.operators.measures import moisture_stats

    s = moisture_stats(climate, value)
    ratio = F.when(F.col("p95") > F.col("p75"), F.col("p75") / F.greatest(F.col("p95"), F.lit(1e-6))).otherwise(1.0)
    return s.select("cell_id", "p75", "p95", F.col("share").alias("pass_normal"), (F.col("share") * ratio).alias("pass_extreme"))


def rainfall(climate: DataFrame, value: str = "pr") -> DataFrame:
    return climate.groupBy("cell_id").agg(F.avg(value).alias("rain_normal"), F.percentile(value, 0.95).alias("rain_extreme"))


def two_scenarios(roads: DataFrame, climate: DataFrame, kcv: Column, slope: Column) -> DataFrame:
    """Speeds of roads with a cell_id in normal and extreme weather; the cell table is one row a cell."""
    cells = passability(climate).join(rainfall(climate), "cell_id")
    joined = roads.join(cells, "cell_id")
    speed = lambda rain, ok: R.roughness_speed(R.roughness(kcv, slope, F.col(rain) / 1000)) * F.col(ok)
    joined = joined.withColumn("v0", speed("rain_normal", "pass_normal")).withColumn("v1", speed("rain_extreme", "pass_extreme"))
    return joined.withColumn("iri0", R.roughness(kcv, slope, F.col("rain_normal") / 1000)).withColumn("iri1", R.roughness(kcv, slope, F.col("rain_extreme") / 1000))


def future_speeds(rows: DataFrame) -> DataFrame:
    """As ``two_scenarios`` gave, with fixed speeds on paved roads, no roughness there, and a floor of 0.5 km/h."""
    paved = ~R.is_unpaved(F.col("surface"))
    pick = lambda k, c: F.round(F.greatest(F.when(paved, C.PAVED_SPEEDS[k]).otherwise(F.col(c)), F.lit(0.5)), 4)
    return rows.withColumn("v0", pick(0, "v0")).withColumn("v1", pick(1, "v1")).withColumn("iri0", F.when(~paved, F.col("iri0"))).withColumn("iri1", F.when(~paved, F.col("iri1")))
