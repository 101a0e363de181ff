"""Health access under other choices: which facilities count, how far they may snap, and what people and facilities snap to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.operators.ranking import grouped_upto
from netaccess.operators.spatial import k_nearest, nearest
from netaccess.runtime import broadcast_if_small, materialize, with_conf

# fixed values: the words that put a facility in a set, the speeds of the way to another anchor, the choice that others are held against
_CLINIC = ("hospital", "clinic", "health centre", "health center", "health_centre", "healthcare")
FACILITY_SETS = {"hospital_only": ("hospital",), "hospital_clinic_healthcentre": _CLINIC, "plus_pharmacy": (*_CLINIC, "pharmacy")}
MAPPINGS = ("nearest_node", "nearest_segment_proxy")
SNAP_KM = (25.0, 50.0, 100.0)
SPEED_NORMAL, SPEED_EXTREME = 40.0, 30.0
DEFAULT_SET, DEFAULT_KM = "plus_pharmacy", 50.0
NEIGHBOURS = 3

VARIANT = ["country_id", "facility_set", "threshold_km", "mapping"]


def proxy_points(nodes: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(proxy, country_id, x, y): the nodes of each country and the middles between each and its nearest others, each place once."""
    near = k_nearest(nodes, "node_id", nodes, "node_id", "x", "y", neighbours + 1, by="country_id")
    at = lambda name: nodes.select(F.col("node_id").alias(name), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"), *(["country_id"] if name == "node_id" else []))
    middle = lambda c: ((F.col(f"node_id_{c}") + F.col(f"neighbour_{c}")) / 2).alias(c)
    middles = near.filter("rank > 1").join(at("node_id"), "node_id").join(at("neighbour"), "neighbour").select("country_id", middle("x"), middle("y"))
    places = nodes.select("country_id", "x", "y").union(middles).distinct()
    return places.select(F.struct("country_id", "x", "y").alias("proxy"), "country_id", "x", "y")


def snapped(points: DataFrame, key: str, nodes: DataFrame, proxies: DataFrame, proxy_nodes: DataFrame, km_per_unit: float) -> DataFrame:
    """(key, mapping, node_id, at_x, at_y, km) of every point of a country with nodes: its node, and the place snapped to, by either mapping."""
    km = (F.sqrt("d2") * km_per_unit).alias("km")
    direct = nearest(points, key, nodes, "node_id", "x", "y", by="country_id").join(nodes.select("node_id", F.col("x").alias("at_x"), F.col("y").alias("at_y")), "node_id")
    via = nearest(points, key, proxies, "proxy", "x", "y", by="country_id").join(proxy_nodes, "proxy")
    return direct.select(key, F.lit(MAPPINGS[0]).alias("mapping"), "node_id", "at_x", "at_y", km).union(via.select(key, F.lit(MAPPINGS[1]), "node_id", "proxy.x", "proxy.y", km))


def member_of(text: Column) -> Column:
    """The sets whose words stand in a text, as an array of names."""
    return F.filter(F.array(*(F.when(text.rlike("|".join(words)), name) for name, words in FACILITY_SETS.items())), lambda x: x.isNotNull())


def health_variants(nodes: DataFrame, sites: DataFrame, people: DataFrame, km_per_unit: float, thresholds: tuple[float, ...] = SNAP_KM) -> DataFrame:
    """``variant_rows``, without broadcasts that the planner chooses by the size of files.

    Variants repeat in every row, so that their files are many times smaller than their rows, which would all pass through the driver.
    """
    with with_conf(nodes.sparkSession, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        return materialize(variant_rows(nodes, sites, people, km_per_unit, thresholds), "variants")


def variant_rows(nodes: DataFrame, sites: DataFrame, people: DataFrame, km_per_unit: float, thresholds: tuple[float, ...] = SNAP_KM) -> DataFrame:
    """A row for each country, facility set, snap threshold and mapping: anchors, exclusions, one-hour coverage, delays, tail gap.

    ``nodes``: node_id, country_id, x, y, t_normal, t_extreme (those without both times take no part). ``sites``: site_id, country_id, x, y,
    text. ``people``: pixel_id, country_id, x, y, weight (whole numbers, so that sums are exact). Countries need nodes and sites.
    A variant's times are those of the nodes, longer or shorter by the way between its nearest anchor and that of the default choice;
    where either has no anchor they stay. Figures of a variant without an anchor or without people within reach are null.
    People are summed by node before they meet variants, and a group's quantiles come from ordered ranges of counted delays.
    """
    nodes = materialize(nodes.filter("t_normal IS NOT NULL AND t_extreme IS NOT NULL"), "variant-nodes")
    proxies = materialize(proxy_points(nodes), "variant-proxies")
    proxy_nodes = materialize(nearest(proxies, "proxy", nodes, "node_id", "x", "y", by="country_id").select("proxy", "node_id"), "variant-proxy-nodes")
    countries = nodes.select("country_id").distinct()
    sites = sites.join(broadcast_if_small(countries), "country_id", "left_semi")
    limits = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold_km")

    placed = snapped(sites, "site_id", nodes, proxies, proxy_nodes, km_per_unit).join(sites.select("site_id", "country_id", member_of(F.col("text")).alias("sets")), "site_id")
    placed = placed.select("country_id", "mapping", "node_id", "at_x", "at_y", "km", F.explode("sets").alias("facility_set"))
    placed = materialize(placed.select("*", limits).withColumn("kept", F.col("km") <= F.col("threshold_km")), "variant-sites")
    counts = placed.groupBy(*VARIANT).agg(F.count("*").alias("n_facilities"), F.count_if("kept").alias("n_facility_anchors"))

    variant = F.struct(*VARIANT).alias("variant")
    kept = placed.filter("kept").join(nodes.select("node_id", "x", "y"), "node_id")
    anchors = kept.select(variant, F.explode(F.array(F.struct(F.col("at_x").cast("double").alias("x"), F.col("at_y").cast("double").alias("y")), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("at")).distinct()
    anchors = materialize(anchors.select("variant", F.struct("variant", "at").alias("anchor"), "at.x", "at.y"), "variant-anchors")
    have = anchors.select("variant").distinct().select("variant", F.col("variant.country_id").alias("country_id"))
    asked = nodes.select("node_id", "country_id", "x", "y").join(have, "country_id").select(F.struct("variant", "node_id").alias("asker"), "variant", "x", "y")
    way = materialize(nearest(asked, "asker", anchors, "anchor", "x", "y", by="variant").select("asker.variant.*", "asker.node_id", (F.sqrt("d2") * km_per_unit).alias("way")), "variant-ways")
    usual = way.filter((F.col("facility_set") == DEFAULT_SET) & (F.col("threshold_km") == DEFAULT_KM)).select("mapping", "node_id", F.col("way").alias("usual"))
    more = F.coalesce(F.col("way") - F.col("usual"), F.lit(0.0))
    longer = lambda t, speed: F.greatest(F.lit(0.0), F.col(t) + more / speed).alias(t)
    times = way.join(usual, ["mapping", "node_id"], "left").join(nodes.select("node_id", "t_normal", "t_extreme"), "node_id")
    times = times.select(*VARIANT, "node_id", longer("t_normal", SPEED_NORMAL), longer("t_extreme", SPEED_EXTREME))

    living = people.filter("weight > 0").join(broadcast_if_small(countries), "country_id", "left_semi")
    total = living.groupBy("country_id").agg(F.sum("weight").alias("everyone"))
    near = snapped(living, "pixel_id", nodes, proxies, proxy_nodes, km_per_unit).join(living.select("pixel_id", "country_id", "weight"), "pixel_id").select("*", limits)
    near = materialize(near.filter(F.col("km") <= F.col("threshold_km")).groupBy("country_id", "mapping", "threshold_km", "node_id").agg(F.sum("weight").alias("weight")), "variant-people")
    within = near.groupBy("country_id", "mapping", "threshold_km").agg(F.sum("weight").alias("included"))

    rows = materialize(times.join(near, ["country_id", "mapping", "threshold_km", "node_id"]).withColumn("delay", F.col("t_extreme") - F.col("t_normal")), "variant-rows")
    hour = lambda t: F.coalesce(F.sum(F.when(F.col(t) <= 1.0, F.col("weight"))), F.lit(0))
    sums = rows.groupBy(*VARIANT).agg(hour("t_normal").alias("c0"), hour("t_extreme").alias("c1"), (F.sum(F.col("delay") * F.col("weight")) / F.sum("weight")).alias("mean_delay"), F.sum("weight").alias("_w"))
    upto = grouped_upto(rows, VARIANT, "delay", F.col("weight")).join(sums.select(*VARIANT, "_w"), VARIANT)
    cut = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_w"), F.col("delay")))
    cuts = upto.groupBy(*VARIANT).agg(cut(0.5).alias("q50"), cut(0.9).alias("q90"))

    names = lambda values: F.explode(F.array(*map(F.lit, values)))
    grid = sites.select("country_id").distinct().select("country_id", names(FACILITY_SETS).alias("facility_set")).select("*", names(thresholds).alias("threshold_km")).select("*", names(MAPPINGS).alias("mapping"))
    out = grid.join(counts, VARIANT, "left").join(total, "country_id", "left").join(within, ["country_id", "mapping", "threshold_km"], "left").join(sums, VARIANT, "left").join(cuts, VARIANT, "left")
    n, kept_n, inside = F.coalesce("n_facilities", F.lit(0)), F.coalesce("n_facility_anchors", F.lit(0)), F.coalesce("included", F.lit(0))
    ok = F.col("c0").isNotNull()
    share = lambda part: F.round((1 - F.try_divide(part, F.col("everyone"))) * 100, 3)
    return out.select(
        *VARIANT, n.alias("n_facilities"), kept_n.alias("n_facility_anchors"), F.round((1 - F.try_divide(kept_n, n)) * 100, 3).alias("excluded_facility_pct"), share(inside).alias("excluded_population_pct"),
        F.when(ok, inside).alias("included_population"), F.col("c0").alias("normal_covered_1h"), F.col("c1").alias("extreme_covered_1h"), F.round(F.try_divide(F.col("c0") - F.col("c1"), "c0"), 6).alias("one_hour_coverage_loss"),
        F.round(F.when(F.col("q50") > 0, F.col("q90") / F.col("q50")), 6).alias("tail_gap_ratio"), F.round("mean_delay", 6).alias("pwmtt_delta"), F.when(ok, "ok").otherwise("no_anchors_or_population").alias("status"),
    )
