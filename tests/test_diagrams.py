"""Sequence diagrams of more lines than are joined at once, and what their plans hold together."""

import random

import pytest

from skeinwork.operators import traverse
from skeinwork.sinks import report


@pytest.mark.parametrize("style", ("mermaid", "plantuml"))
def test_chunks_keep_the_order(spark, monkeypatch, style):
    monkeypatch.setattr(report, "_CHUNK_BITS", 2)
    rows = [(top, f"a{n:06}/", 0, "call", f"{top}.m", f"S{n}.go") for top in ("A", "B") for n in range(211)]
    random.Random(3).shuffle(rows)
    flow = spark.createDataFrame(rows, "top string, sort_path string, step int, kind string, source string, target string").repartition(7)
    pad, arrow, head, tail = ("    ", "->>", "sequenceDiagram\n", "") if style == "mermaid" else ("", "->", "@startuml\n", "\n@enduml")
    want = {top: head + "\n".join(f"{pad}{top}{arrow}S{n}: go" for n in range(211)) + tail for top in ("A", "B")}
    assert {r.top: r.text for r in report.sequence_text(flow, style).collect()} == want


def test_no_paths_are_collected_and_no_events_broadcast(spark):
    calls = spark.createDataFrame([("C.a", "S.b", 1), ("S.b", "M.c", 1)], "src string, dst string, call_order int")
    runs, uses = spark.createDataFrame([("M.c", "c")], "method string, sql_id string"), spark.createDataFrame([("c", "t")], "sql_id string, table_name string")
    events = traverse.sequence_events(calls, runs, uses, spark.createDataFrame([("C.a",)], "top string"))
    assert "Broadcast" not in events._jdf.queryExecution().executedPlan().toString()
    text = report.sequence_text(traverse.activation_flow(events))
    assert "collect_list(struct(sort_path" not in text._jdf.queryExecution().optimizedPlan().toString().replace("named_struct(", "struct(").replace("struct(sort_path, sort_path", "struct(sort_path")
    assert text.first().text.split("\n")[1:3] == ["    C->>S: b", "    S->>M: c"]
