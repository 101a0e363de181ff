"""Measures of road lines, kept as arrays of (x, y) points in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_steps(line: Column) -> Column:
    """The straight steps of a line, as structs of a, b (points) and d (length); none for fewer than two points."""
    def step(i: Column) -> Column:
        a, b = F.get(line, i), F.get(line, i + 1)
        return F.struct(a.alias("a"), b.alias("b"), F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2))).alias("d"))

    return F.when(F.size(line) > 1, F.transform(F.sequence(F.lit(0), F.size(line) - 2), step)).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,d:double>>"))


def line_length(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda s, e: s + e["d"])


def point_along(line: Column, steps: Column, share: float) -> Column:
    """The point at a share of the line's length; the first point of a line without length, null without points."""
    first = F.get(line, F.lit(0))
    start = F.struct((line_length(steps) * share).alias("left"), first["x"].alias("x"), first["y"].alias("y"), F.lit(False).alias("done"))

    def walk(s: Column, e: Column) -> Column:
        part = F.coalesce(F.try_divide(F.least(s["left"], e["d"]), e["d"]), F.lit(0.0))
        at = lambda k: F.when(s["done"], s[k]).otherwise(e["a"][k] + (e["b"][k] - e["a"][k]) * part)
        return F.struct(F.when(s["done"], s["left"]).otherwise(s["left"] - e["d"]).alias("left"), at("x").alias("x"), at("y").alias("y"), (s["done"] | (e["d"] >= s["left"])).alias("done"))

    return F.when(F.size(line) > 0, F.aggregate(steps, start, walk, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))))


def line_centroid(line: Column, steps: Column, axis: str) -> Column:
    """Mean of the steps' middles weighted by their lengths; the first point of a line without length."""
    moment = F.aggregate(steps, F.lit(0.0), lambda s, e: s + (e["a"][axis] + e["b"][axis]) / 2 * e["d"])
    return F.coalesce(F.try_divide(moment, line_length(steps)), F.get(line, F.lit(0))[axis])
