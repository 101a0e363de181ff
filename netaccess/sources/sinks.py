"""Sinks: tables, partitions by group, JSON beside a table, and skipping what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """``mode``: overwrite, or ignore to keep a table that is there (a resumed run)."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_groups(df: DataFrame, path: str, keys: list[str], least: int = 1) -> None:
    """One partition for each group of at least ``least`` rows."""
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    df.join(large, keys, "left_semi").repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def json_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def markdown(rows: list, columns: list[str]) -> str:
    """A small report table of rows already on the driver."""
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    return "\n".join([head, *(f"| {' | '.join(str(r[c]) for c in columns)} |" for r in rows)])
