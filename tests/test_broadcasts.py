"""Joins of tables that grow with the sources are dealt out by key: none of their sides goes through the driver whole, however small it is taken to be."""

import pytest

from skeinwork.plans import codebase


@pytest.mark.parametrize("name", ["injected_interfaces", "class_specification", "class_texts", "result_map_audit", "test_class_facts", "bean_injection", "class_details"])
def test_nothing_is_broadcast(spark, small, name):
    plan = codebase.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["class_specification", "class_texts", "result_map_audit", "test_class_facts", "bean_injection", "class_details"])
def test_sources_are_cut_once(spark, small, name):
    assert "MapInArrow" not in codebase.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
