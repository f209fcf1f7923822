"""Shapes of plans: what is read, and what moves."""

import re

from skeinwork.plans import catalogue


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, small):
    plan = _plan(catalogue.QUERIES["mapper_distribution"](spark, small))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and not any("o_totalprice" in r or "l_extendedprice" in r for r in read)
    assert "Cartesian" not in plan and "Python" not in plan


def test_filters_reach_the_scan(spark, small):
    plan = _plan(catalogue.QUERIES["optional_filters"](spark, small))
    assert "EqualTo(event_type,click)" in plan and "Exchange" not in plan


def test_aggregates_are_partial_before_they_move(spark, small):
    for name in ("complexity_histogram", "sql_stats", "upsert_latest"):
        assert "partial_" in _plan(catalogue.QUERIES[name](spark, small))


def test_no_python_in_expressions(spark, small):
    for name in ("sql_metadata", "name_rules", "string_naming", "mapping_audit", "crud_matrix"):
        plan = _plan(catalogue.QUERIES[name](spark, small))
        assert not re.search("Python|Arrow|Pandas|Cartesian", plan)
