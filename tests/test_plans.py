"""Physical plans of the registered queries: nothing that pairs all rows or gathers a table."""

import re

import pytest

from kinweave.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"

# These run jobs while they are built, so that their last plan says little.
EAGER = {"shortest_path", "shortest_path_directed", "shortest_path_skewed", "nth_candidate", "nth_candidate_repeated"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    # A window without partition keys would sort the whole table in one task.
    for window in re.findall(r"Window \[.*", plan):
        keys = re.search(r"\], \[(.*?)\]", window)
        assert keys and keys.group(1), window


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["age_gap_analysis"](spark, SF_DIR)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any(s == "c_custkey:bigint,c_nationkey:int" for s in schemas)
    assert not any("c_acctbal" in s or "o_totalprice" in s for s in schemas)


def test_warm_up_filter_needs_no_window(spark):
    plan = QUERIES["run_stats_warm"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Window" not in plan
