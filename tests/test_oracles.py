"""Registered plans against their SQL on the driver tables. LODESTAR_ALL=1 runs every query."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
import __spark_entry__ as entry_point
from check_oracle import compare, connect
from lodestar.plans import QUERIES

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
CORE = ["spike_removal", "total_return_index", "asof_backward", "monthly_returns", "performance_stats", "risk_story", "te_edges", "estimate_mu_beta",
        "portfolio_perf", "calendar_rebalance_returns", "change_log", "master_merge", "representatives", "etf_filter", "content_similarity",
        "look_through", "overlap_pairs", "universe_build", "list_ingest", "te_clusters", "coverage_report", "classify_region", "normalise_rows", "csv_export",
        "twin_theta_join", "content_twins", "rate_twins", "proxy_choice", "stratified_sample", "price_store_tables", "json_field_report", "selection_covariance",
        "pair_self_join", "cluster_stats", "cluster_alternates", "name_control", "weight_scan"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [q for q in entry_point.oracle_sql() if q in QUERIES] if os.environ.get("LODESTAR_ALL") else CORE)
def test_matches_sql(spark, con, name):
    message, _, good = compare(spark, con, name, SF)
    assert good, message


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_point.oracle_sql())
