"""Traversal, impact, upserts and reports on small hand-made tables and random graphs."""

import random

from pyspark.sql import functions as F

from skeinwork.operators import impact, linkage, predicates, traverse, upsert
from skeinwork.sinks import report

EDGES = [("C.a", "S.b"), ("S.b", "M.c"), ("S.d", "M.c"), ("C.e", "S.d"), ("S.b", "S.d"), ("S.d", "S.b")]


def _trails(edges, start, depth):
    found, at = set(), [(start, ())]
    for d in range(1, depth + 1):
        at = [(b, used + ((a, b),)) for node, used in at for a, b in edges if a == node and (a, b) not in used]
        found |= {(node, d) for node, _ in at}
    return found


def test_reverse_depths(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    got = traverse.reverse(e, spark.createDataFrame([("M.c",)], "target string"), 10)
    want = {("S.b", 1), ("S.d", 1), ("C.a", 2), ("S.d", 2), ("S.b", 2), ("C.e", 2), ("C.e", 3), ("C.a", 3), ("S.b", 3), ("S.d", 3), ("C.a", 4), ("C.e", 4)}
    assert {(r.caller, r.depth) for r in got.collect()} == want
    assert {r.path for r in traverse.cycles(e, 10).collect()} == {"S.b>S.d>S.b", "S.d>S.b>S.d"}
    short = traverse.reverse(e, spark.createDataFrame([("M.c",)], "target string"), 10, mode="shortest")
    assert {(r.caller, r.depth) for r in short.collect()} == {("S.b", 1), ("S.d", 1), ("C.a", 2), ("C.e", 2)}


def test_trails_on_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(3):
        edges = list({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(11)})
        e = spark.createDataFrame(edges, "src string, dst string")
        starts = spark.createDataFrame([(f"n{k}",) for k in range(3)], "start string")
        got = {(r.start, r.node, r.depth) for r in traverse.trails(e, starts, 5).collect()}
        assert got == {(f"n{k}", node, d) for k in range(3) for node, d in _trails(edges, f"n{k}", 5)}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert traverse.forward(none, spark.createDataFrame([("x",)], "start string"), 3).collect()[0].depth == 0
    assert traverse.cycles(none).count() == 0


def test_impact(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    statements = spark.createDataFrame([("p", "M", "c", "SELECT", 6), ("p", "M", "u", "UPDATE", 1)], "project string, mapper_name string, id string, sql_type string, complexity_score int")
    uses = spark.createDataFrame([("p", "M", "c", "T1"), ("p", "M", "u", "t1")], "project string, mapper_name string, sql_id string, table_name string")
    links = spark.createDataFrame([("p", "M", "c", "M.c"), ("p", "M", "u", "M.u")], "project string, mapper_name string, sql_id string, method string")
    nodes = sorted({x for pair in EDGES for x in pair} | {"M.u"})
    methods = spark.createDataFrame([(n, "", *n.split(".")) for n in nodes], "node string, package_name string, class_name string, method string")
    rows = impact.table_impact("t1", statements, uses, links, e, methods)
    got = {(r.caller, r.depth): r.risk for r in rows.collect()}
    assert len(got) == 14 and set(got.values()) == {"MEDIUM"}  # of 14 rows; M.u: 10 + 0 + 20 + 10
    total = impact.summary(rows).first()
    assert (total.classes, total.methods, total.max_depth) == (3, 6, 4)
    assert impact.package_summary(rows).first().package == "default"


def test_sequence(spark):
    calls = spark.createDataFrame([("C.x", "S.a", 1), ("C.x", "S.b", 2), ("S.a", "M.q", 1)], "src string, dst string, call_order int")
    runs = spark.createDataFrame([("M.q", "q1")], "method string, sql_id string")
    uses = spark.createDataFrame([("q1", "t1")], "sql_id string, table_name string")
    tops = spark.createDataFrame([("C.x",)], "top string")
    events = traverse.sequence_events(calls, runs, uses, tops, 5)
    order = [(r.kind, r.target, r.depth) for r in events.orderBy("sort_path").collect()]
    assert order == [("call", "S.a", 1), ("call", "M.q", 2), ("sql", "q1", 3), ("table", "t1", 4), ("call", "S.b", 1)]
    flow = traverse.activation_flow(events)
    steps = [(r.kind, r.source, r.target) for r in flow.orderBy("sort_path", "step").collect()]
    assert steps == [("call", "C.x", "S.a"), ("call", "S.a", "M.q"), ("sql", "M.q", "q1"), ("return", "M.q", "S.a"), ("return", "S.a", "C.x"), ("call", "C.x", "S.b"), ("return", "S.b", "C.x")]
    text = report.sequence_text(flow).first().text
    assert text.startswith("sequenceDiagram\n    C->>S: a\n    S->>M: q") and "C: return" in text
    assert report.sequence_text(flow, "plantuml").first().text.endswith("@enduml")
    assert traverse.sequence_events(calls, runs, uses, tops, 0).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 2, "z"), ("b", 3, "w"), ("c", 1, None), (None, 1, "n")], "k string, seq int, v string")
    once = upsert.upsert(old, new, ["k"], ["seq"], first_wins=())
    want = {("a", 1, "x"), ("b", 3, "w"), ("c", 1, None), (None, 1, "n")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in upsert.upsert(once, new, ["k"], ["seq"]).collect()} == want
    assert {tuple(r) for r in upsert.upsert(old, new.orderBy(F.desc("v")), ["k"], ["seq"], first_wins=("v",)).collect()} == {("a", 1, "x"), ("b", 3, "y"), ("c", 1, None), (None, 1, "n")}
    left = upsert.delete_related({"t": old, "u": new}, new.filter("k = 'b'"), {"t": {"k": "k"}})
    assert [r.k for r in left["t"].collect()] == ["a"] and left["u"].count() == 4
    named = spark.createDataFrame([("p.Big.go",), ("p.Bigger.go",), ("x",), (None,), ("",)], "k string")
    gone = spark.createDataFrame([("Big.",), ("x",), (None,), ("",), ("longer than any",)], "g string")
    assert {r.k for r in upsert.delete_related({"t": named}, gone, {}, {"t": {"k": "g"}})["t"].collect()} == {"p.Bigger.go", None, ""}
    assert upsert.delete_related({"t": named}, gone.limit(0), {}, {"t": {"k": "g"}})["t"].count() == 5
    changed = upsert.update_columns(old, spark.createDataFrame([("a", "q")], "k string, v string"), ["k"], ["v"])
    assert {tuple(r) for r in changed.collect()} == {("a", 1, "q"), ("b", 1, "y")}


def test_optional_match(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, name string")
    many = spark.createDataFrame([(1, "x", 5), (1, "x", 6), (1, "y", None), (None, "z", 1)], "id int, kind string, n int")
    got = linkage.optional_match(rows, [linkage.Branch(many, {"k": "id"}, {"n": "n"}, {"kinds": "kind"}), linkage.Branch(many.limit(0), {"k": "id"}, {"none": "n"})])
    assert {tuple(r) for r in got.collect()} == {(1, "a", 2, "x,y", 0), (2, "b", 0, "", 0), (None, "c", 0, "", 0)}


def test_predicates(spark):
    s = F.lit
    r = spark.range(1).select(
        predicates.is_noise_call(s("A"), s("A"), s("hashCode")), predicates.in_project(s("null"), "p"), predicates.in_project(s("x"), None), predicates.is_suppressed_call(s("log"), s("info")),
        predicates.touches_table(F.array(F.struct(s("user_roles").alias("name"))), "user"), predicates.touches_table(F.array(F.struct(s("user_roles").alias("name"))), "user", compat=True),
    ).first()
    assert tuple(r) == (True, False, True, True, False, True)
    df = spark.createDataFrame([("A", "m", None, "src"), ("A", "k", "", "src"), ("B", "z", "done", "src"), ("B", "y", None, "")], "class_name string, name string, ai_description string, source string")
    assert [r.name for r in predicates.needs_enrichment(df, limit=1).collect()] == ["k"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 2), ("a", None)], "name string, n int")
    assert report.markdown_table(rows, ["name"]).first().text == "| name | n |\n|---|---|\n| a |  |\n| b\\|c | 2 |"
    edges = spark.createDataFrame([("A.x", "B.y", "R"), ("A.x", "C", None)], "src string, dst string, label string")
    assert report.mermaid_graph(edges).first().text == 'graph TD\n    A_x["A.x"] -->|R| B_y["B.y"]\n    A_x["A.x"] --> C["C"]'
    report.write_sheets({"s": rows}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2
