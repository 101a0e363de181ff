"""Predicates, classes and safe arithmetic as Column functions; missing values are NULL, never NaN."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from netaccess import config as C


def is_unpaved(surface: Column) -> Column:
    return F.coalesce(F.lower(surface).contains("unpaved"), F.lit(False))


def finite(x: Column) -> Column:
    """x as a finite double, else NULL."""
    d = x.try_cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def pct_increase(t0: Column, t1: Column) -> Column:
    return F.when(t0.isNotNull() & t1.isNotNull() & (t0 > 0), (t1 - t0) / t0 * 100)


def severe(increase: Column) -> Column:
    return F.coalesce(increase >= C.SEVERE_INCREASE_PCT, F.lit(False)).cast("int")


def connection_type(t0: Column, t1: Column) -> Column:
    return (
        F.when(t0.isNull() & t1.isNull(), "both_unreachable").when(t0.isNull(), "normal_unreachable")
        .when(t1.isNull(), "climate_disconnected").otherwise("connected")
    )


def block_probability(pass_rate: Column, v_normal: Column, v_extreme: Column) -> Column:
    """1 - passable rate, or the relative speed loss where the rate is missing; within 0 and the cap."""
    clipped = 1 - F.least(F.greatest(pass_rate, F.lit(0.0)), F.lit(1.0))
    p = F.when(pass_rate.isNotNull(), clipped).otherwise(F.when(v_normal > 0, (v_normal - v_extreme) / v_normal))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(C.MAX_BLOCK))


def speed_drop_pct(v_normal: Column, v_extreme: Column) -> Column:
    return F.when(v_normal > 0, (v_normal - v_extreme) / v_normal * 100)


def first_box(lon: Column, lat: Column, boxes: list[tuple[str, float, float, float, float]], other: str = "Other") -> Column:
    """Name of the first box (name, lon from, lon to, lat from, lat to) that holds the point."""
    out = None
    for name, x0, x1, y0, y1 in boxes:
        inside = lon.between(x0, x1) & lat.between(y0, y1)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return F.lit(other) if out is None else out.otherwise(other)


def step_class(x: Column, bounds: list[float]) -> Column:
    """0 below the first bound, 1 below the second and so on; negative values are 0."""
    out = F.when(x < bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(x < b, i)
    return out.otherwise(F.when(x.isNotNull(), len(bounds)))


def neutral(w0: Column, w1: Column, rtol: float = 1e-10, atol: float = 1e-12) -> Column:
    return F.abs(w0 - w1) <= atol + rtol * F.abs(w1)


def place_level(featurecla: Column, pop: Column, threshold: int) -> Column:
    """Ordered rules: national capital, regional capital, large place, else NULL."""
    return F.when(featurecla.startswith("Admin-0"), "capital").when(featurecla.startswith("Admin-1"), "regional").when(pop >= threshold, "city")


def roughness(
    kcv: Column, slope_pct: Column, mmp: Column, months: int = 12, *, light: Column | float = C.ADL, heavy: Column | float = C.ADH, total: Column | float = C.ADT, depth: Column | float = C.MGD, floor: Column | float = C.IRI_FLOOR, start: Column | float = C.IRI0,
) -> Column:
    """Unpaved roughness after monthly steps r <- M - p (M - r), in its closed form."""
    # fixed values: coefficients of the published unpaved-road deterioration model
    limit = F.greatest(21.4 - 32.4 * (0.5 - depth) ** 2 + 0.97 * kcv - 7.64 * slope_pct * mmp, floor if isinstance(floor, Column) else F.lit(floor))
    keep = F.exp(-0.001 * (0.461 + 0.0174 * light + 0.0114 * heavy - 0.0287 * total * mmp) * C.DT_YEARS)
    return limit - F.pow(keep, F.lit(months)) * (limit - start)


def interpolate(x: Column, nodes: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise-linear through the nodes, held flat beyond both ends."""
    out = F.when(x <= nodes[0][0], nodes[0][1])
    for (x0, y0), (x1, y1) in zip(nodes, nodes[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), nodes[-1][1])


def roughness_speed(iri: Column) -> Column:
    return interpolate(F.least(F.greatest(iri, F.lit(6.0)), F.lit(20.0)), C.ROUGHNESS_SPEED)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def degree_label(x: Column, positive: str, negative: str) -> Column:
    n = F.abs(x).cast("int").cast("string")
    return F.when(x == 0, "0°").when(x > 0, F.concat(n, F.lit("°" + positive))).otherwise(F.concat(n, F.lit("°" + negative)))


def normal_name(name: Column) -> Column:
    """Lower-case without apostrophes, hyphens as spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("'"), F.lit("")), F.lit("-"), F.lit(" ")), r"\s+", " "))


def plain_letters() -> tuple[str, str]:
    """Letters with marks and their plain ASCII letters, side by side: by the rule of compatibility decomposition, over the Latin blocks."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for block in ((0xA0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)) for c in range(*block)]
    return "".join(a for a, b in pairs if len(b) == 1), "".join(b for a, b in pairs if len(b) == 1)


def folded_name(name: Column) -> Column:
    """``normal_name`` after letters have lost their marks and what is not ASCII then has gone."""
    return normal_name(F.regexp_replace(F.translate(name, *plain_letters()), r"[^\x00-\x7F]", ""))
