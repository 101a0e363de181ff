"""Registered queries: twins exist for what SQL can express, the flagship runs, plans push filters and avoid nested loops."""

import pytest

import __spark_entry__
from netaccess.plans import registry
from netaccess.plans.bindings import VIEWS, needed, with_sql

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"ac2_buffering", "gr1_endpoint_merge", "gr4_border_links", "gr8_forced_path", "gr12_bridges", "gr13_edge_betweenness", "gr15_percolation", "gr15_tipping_point", "gr17_gravity_betweenness", "gr19_demand_nodes", "od6_district_metrics", "od6_district_row", "od7_critical_roads", "od8_country_driver", "stb_spearman_p", "stc_significance", "stg_kmeans", "gr12_country_bridges", "sm2_recovery_curves"}


def test_every_query_has_a_twin_or_is_listed():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == ROWS_ONLY
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry_and_queries_agree():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert {"ag3_road_degradation", "gr6_multi_source_sp"} <= set(known)


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[-1] == "rank" and df.count() == 10


def test_views_are_ordered_below_first():
    order = needed(("edges",))
    assert order.index("roads") < order.index("edges") and order.index("lineitem") < order.index("roads")
    assert with_sql(("edges",), "WITH RECURSIVE d AS (SELECT 1) SELECT * FROM d").startswith("WITH RECURSIVE roads AS")
    assert all(below in VIEWS or below in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") for below, in [(b,) for v in VIEWS.values() for b in v[0]])


@pytest.mark.parametrize("key", ["jn25_interval_overlap", "sp5_eps_pairs", "sp2_nearest_place"])
def test_no_nested_loops(spark, key):
    plan = registry.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["fd1_dates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan
