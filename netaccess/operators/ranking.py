"""Ranks and running sums over a whole table without one task holding it.

``repartitionByRange`` puts rows into ordered ranges; each range is ranked on its own and shifted by what
the ranges before it hold. A window without partition columns would send every row to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netaccess.runtime import materialize


def written(df: DataFrame) -> DataFrame:
    return df if hasattr(df, "_written_path") else materialize(df, "rank-rows")


def ordered_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_part``, the number of the ordered range that a row lies in; written, so that ranges hold still."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def offsets(parts: DataFrame, value: Column) -> DataFrame:
    """For each range, the sum of ``value`` over the ranges before it: as many rows as ranges."""
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers from 1 over the whole order, which should be total."""
    parts = ordered_ranges(df, order)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(offsets(parts, F.lit(1)), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_part")


def grouped_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers from 1 within ``keys`` over an order that should be total; one key may hold all rows, as its ranges are ranked apart."""
    parts = ordered_ranges(df, [*map(F.col, keys), *order])
    own = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # ranges lie side by side: as many rows as ranges and keys
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*keys, "_part", before.alias("_before"))
    return parts.withColumn("_own", own).join(shifts, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_part")


def grouped_upto(df: DataFrame, keys: list[str], column: str, weight: Column, descending: bool = False) -> DataFrame:
    """(keys, column, _c, _upto): for each distinct value within ``keys`` its weight and the weight up to and with it."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum(weight).alias("_c"))
    order = [F.desc(column) if descending else F.asc(column)]
    parts = ordered_ranges(counts, [*map(F.col, keys), *order])
    own = F.sum("_c").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = parts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_own", own).join(sizes.select(*keys, "_part", before.alias("_before")), [*keys, "_part"])
    return placed.select(*keys, column, "_c", (F.col("_before") + F.col("_own")).alias("_upto"))


def grouped_value_ranks(df: DataFrame, keys: list[str], column: str, descending: bool = False, times: Column | None = None) -> DataFrame:
    """``df`` with min_rank and avg_rank of a column within ``keys``, each row counted ``times`` (default: once): equal values
    are counted first, so that ties meet before any order. Rows are written first, as in ``value_ranks``."""
    df = written(df)
    upto = grouped_upto(df, keys, column, F.lit(1) if times is None else times, descending)
    ranked = upto.select(*keys, column, (F.col("_upto") - F.col("_c") + 1).alias("min_rank"), (F.col("_upto") - (F.col("_c") - 1) / 2).alias("avg_rank"))
    return df.join(ranked, [*keys, column], "left")


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, shares: tuple[float, ...]) -> DataFrame:
    """keys and q_<position>: interpolated quantiles of a column within ``keys``, from values counted and ordered in ranges, so
    that a group may hold most rows. Groups without a value have no row."""
    upto = materialize(grouped_upto(df, keys, column, F.lit(1)), "quantile-groups")
    placed = upto.join(upto.groupBy(*keys).agg(F.sum("_c").alias("_n")), keys)
    out = []
    for i, q in enumerate(shares):
        place = (F.col("_n") - 1) * F.lit(q)
        at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(column)))
        out.append((at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * F.max(place - F.floor(place))).alias(f"q_{i}"))
    return placed.groupBy(*keys).agg(*out)


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row in the whole order."""
    parts = ordered_ranges(df.withColumn("_value", value), order)
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_own", own).join(offsets(parts, F.col("_value")), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_part", "_value")


def value_ranks(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """``df`` with min_rank and avg_rank of a column: values are counted first, so ties meet before any order.

    Rows are written first: a sum of doubles made once to be counted and once more to be joined may differ in its last digit.
    """
    df = written(df)
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    order = [F.desc("_v") if descending else F.asc("_v")]
    ranked = running_sum(counts, order, F.col("_c"), "_upto")
    ranked = ranked.select("_v", (F.col("_upto") - F.col("_c") + 1).alias("min_rank"), (F.col("_upto") - (F.col("_c") - 1) / 2).alias("avg_rank"))
    return df.join(ranked, df[column] == ranked["_v"], "left").drop("_v")


def quantiles(df: DataFrame, values: dict[str, tuple[Column, tuple[float, ...]]]) -> DataFrame:
    """One row: for each name and its (value, shares), the interpolated quantiles of the whole table as <name>_<position>; null without values.

    Equal values are counted first and ordered in ranges, so that no task or buffer holds the distinct values of the table.
    """
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, (v, _) in values.items()))).alias("e")).select("e._name", "e._v")
    counts = rows.filter(F.col("_v").isNotNull()).groupBy("_name", "_v").agg(F.count("*").alias("_c"))
    upto = materialize(running_sum(counts, [F.asc("_name"), F.asc("_v")], F.col("_c"), "_upto"), "quantile-counts")
    ends = upto.groupBy("_name").agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_from"))
    placed = upto.join(F.broadcast(ends), "_name")  # a row for each name
    reach = F.col("_upto") - F.col("_from")
    out = []
    for name, (_, shares) in values.items():
        for i, q in enumerate(shares):
            place = (F.col("_n") - 1) * F.lit(q)
            at = lambda k: F.min(F.when((F.col("_name") == name) & (reach > k), F.col("_v")))  # noqa: B023, E731
            share = F.max(F.when(F.col("_name") == name, place - F.floor(place)))
            out.append((at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * share).alias(f"{name}_{i}"))
    return placed.agg(*out)
