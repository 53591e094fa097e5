"""Registered queries against their SQL on the smallest tables.

``CODEFACTS_ALL_QUERIES=1`` runs every query; by default one per operator
family, since the whole set takes some minutes.
"""

import os
from pathlib import Path

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from codefacts.plans import oracle
from codefacts.plans import queries as registered

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle.oracle_sql()
# The training-data queries, if they are there, have tests of their own.
QUERIES = {name: entry.queries()[name] for name in registered.REGISTRY}
SAMPLE = (
    "table_link_resolutions", "table_symbol_tokens", "list_callers_target", "list_linked_callees", "plane_diff",
    "find_symbol_target", "find_symbol_exact", "describe_symbol_definitions", "list_targets", "collect_losers",
    "list_weak_symbols_target", "list_undefined_symbols", "list_entry_points", "list_icf_groups",
    "explain_call_overall", "resolve_indirect_call_counts", "find_type", "list_source_drift", "read_source_slice",
    "search_source_page", "search_source_by_dir", "search_source_regex", "recipe_call_decisions", "scan_objdump",
    "scan_map", "symbol_merge", "prune_unreferenced", "assign_ids", "edges_objdump", "types_dedup", "preflight",
)
CHOSEN = list(QUERIES) if os.environ.get("CODEFACTS_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry_is_a_frame_with_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["caller_usr", "callee_usr", "verdict", "reason", "cgraph_inlined", "linked_edge"]
    assert not df.isEmpty()


@pytest.mark.parametrize("name", ["list_callers", "table_call_edges", "find_symbol_fts", "search_source_by_file"])
def test_plans_have_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_line_filters_reach_the_scan(spark):
    plan = QUERIES["table_symbol_definitions"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_linenumber, [6,7])" in plan
    assert "l_extendedprice" not in plan
