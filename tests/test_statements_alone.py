"""Statements of a source tree are had without its calls and beans."""

from skeinwork import project
from skeinwork.operators import calltargets, jpa
from skeinwork.plans import codebase
from skeinwork.sources import java


def test_calls_are_not_resolved(spark, small, monkeypatch):
    def never(*args):
        raise AssertionError("calls resolved")

    monkeypatch.setattr(calltargets, "resolve_calls", never)
    rows = codebase.QUERIES["merged_statements"](spark, small).collect()
    assert {r.id for r in rows} >= {"dropAll", "saveRow", "recount", "add", "put", "drop"} and callable(project.statements)


def test_mappers_are_not_broadcast(spark):
    t = java.tables_of(java.parsed_classes(spark.createDataFrame([("M.java", "@Mapper interface M { int find(); }")], "file_path string, value string")), "p")
    rows = jpa.mapper_statements(t["class"], t["method"])
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 1
