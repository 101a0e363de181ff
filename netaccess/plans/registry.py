"""Every registered query of the accessibility engine, with its ANSI SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from netaccess.plans.bindings import views, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("filters", "joins", "aggregates", "windows", "ranking", "scalars", "climate", "spatial", "graphs", "access", "networks", "statistics", "scenarios", "paving", "stability", "variants", "districts")


def query(key: str, *names: str, sql: str | None = None):
    """Register a function of the named views (as positional DataFrames) under ``key``, with its twin."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = views(spark, sf_dir, *names)
            return build(*(frames[n] for n in names))

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = with_sql(names, sql)
        return build

    return register


def load() -> None:
    for name in MODULES:
        import_module(f"netaccess.plans.{name}")


load()
