"""Scans: delimited files with fixed schemas, many files at once, folders by country, climate file names, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """Delimited files with a header and a fixed schema; ``columns`` prunes the scan."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def read_glob(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """Every file of a pattern in one scan, with the name of its file; unreadable files are left out."""
    df = spark.read.schema(schema).option("header", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).csv(pattern)
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def country_of_file(file: Column, suffix: str) -> Column:
    """``Kenya_road_speed.csv`` -> ``Kenya`` for the suffix ``_road_speed.csv``."""
    return F.regexp_extract(file, f"^(.*){suffix.replace('.', '[.]')}$", 1)


def missing_countries(found: DataFrame, countries: DataFrame) -> DataFrame:
    """Countries of the dimension that no file gave rows for."""
    return countries.join(found.select("country").distinct(), "country", "left_anti")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """The first of the names that is a column, else a constant."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(default)


def find_column(df: DataFrame, words: list[str]) -> str:
    """The only column whose lower-case name holds every word."""
    found = [c for c in df.columns if all(w in c.lower() for w in words)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns hold {words}")
    return found[0]


def coalesced(primary: DataFrame | None, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the primary table, and those of the fallback whose keys it lacks."""
    if primary is None:
        return fallback
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


CLIMATE_NAME = r"^(?<v>[a-z]+)_AFR-44_(.+?)_(rcp\d\d|historical)_r1i1p1_(.+?)_v\d+_(mon|day)_(\d{4})\d*-(\d{4})\d*\.nc$"


def climate_inventory(names: DataFrame) -> DataFrame:
    """file names -> variable, model, scenario, frequency, first and last year; others are left out."""
    part = lambda k: F.regexp_extract("file", CLIMATE_NAME, k)
    return names.filter(F.col("file").rlike(CLIMATE_NAME)).select("file", part(1).alias("var"), part(2).alias("gcm"), part(3).alias("rcp"), part(5).alias("freq"), part(6).cast("int").alias("first_year"), part(7).cast("int").alias("last_year"))


def overlapping_years(inventory: DataFrame, first: int, last: int) -> DataFrame:
    return inventory.filter((F.col("first_year") <= last) & (F.col("last_year") >= first))


def positive_pixels(raster: DataFrame, nodata: float, lon0: float, lat0: float, step: float, block: int = 1) -> DataFrame:
    """lon, lat, pop of cells over 0 from (row, col, pop), summed over blocks; nodata, negative and missing cells are 0."""
    pop = F.when((F.col("pop") != nodata) & (F.col("pop") > 0), F.col("pop")).otherwise(0.0)
    cells = raster.groupBy(F.floor(F.col("row") / block).alias("r"), F.floor(F.col("col") / block).alias("c")).agg(F.sum(pop).alias("pop"))
    size = step * block
    return cells.filter("pop > 0").select((lon0 + (F.col("c") + 0.5) * size).alias("lon"), (lat0 - (F.col("r") + 0.5) * size).alias("lat"), "pop")


def report_numbers(text: Column) -> Column:
    """R2 and the number of observations from the text of a regression report."""
    r2 = F.regexp_extract(text, r"R-squared:\s+(-?[0-9.]+)", 1).try_cast("double")
    n = F.regexp_extract(text, r"No\. Observations:\s+(\d+)", 1).try_cast("bigint")
    return F.struct(r2.alias("r2"), n.alias("n"))


def cast_columns(df: DataFrame, types: dict[str, DataType | str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})
