"""Traversal of dense graphs: no enumeration of ways where there are no cycles, the same rows as a walk edge by edge where there are."""

import random
import time

from skeinwork.operators import condense, traverse


def _walks(edges, starts, depth):
    out, steps = set(), {}
    for a, b in set(edges):
        steps.setdefault(a, []).append(b)

    def go(start, node, used, d):
        for b in steps.get(node, ()):
            if (node, b) not in used and d < depth:
                out.add((start, b, d + 1))
                go(start, b, used | {(node, b)}, d + 1)

    for s in starts:
        go(s, s, frozenset(), 0)
    return out


def test_trails_against_a_walk(spark):
    rng = random.Random(1)
    for _ in range(4):
        edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)] + [(f"n{k}", f"m{rng.randrange(3)}") for k in range(9)]
        e = spark.createDataFrame(edges, "src string, dst string")
        starts = spark.createDataFrame([("n0",), ("n1",)], "start string")
        got = {(r.start, r.node, r.depth) for r in traverse.trails(e, starts, 6).collect()}
        assert got == _walks(edges, ["n0", "n1"], 6)


def test_a_dense_acyclic_graph(spark):
    """Ten levels of 35 nodes, each calling 30 of the next: over 10,000 edges and 10**14 ways, but few rows."""
    rng = random.Random(2)
    edges = [(f"l{d}n{a}", f"l{d + 1}n{b}") for d in range(10) for a in range(35) for b in rng.sample(range(35), 30)]
    began = time.time()
    rows = traverse.reverse(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("l10n0",), ("l10n1",)], "target string")).collect()
    assert len(edges) > 10_000 and {r.depth for r in rows} == set(range(1, 11)) and len(rows) <= 2 * 10 * 35
    assert time.time() - began < 120


def test_components(spark):
    """Random graphs against reachability by hand; a chain of 3,000 nodes that ends in a ring takes few rounds."""
    rng = random.Random(3)
    for n, m in ((12, 16), (30, 45), (5, 20)):
        edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        nodes = {x for e in edges for x in e}
        reach = {x: {y for _, y, _ in _walks([e for e in edges], [x], 1)} for x in nodes}
        while True:
            more = {x: reach[x].union(*(reach[y] for y in reach[x])) for x in nodes}
            if more == reach:
                break
            reach = more
        want = {x: min([y for y in nodes if y in reach[x] and x in reach[y]]) for x in nodes if any(y != x and y in reach[x] and x in reach[y] for y in nodes)}
        got = condense.strong_components(spark.createDataFrame(list(edges), "src string, dst string"))
        assert {r.node: r.component for r in got.collect()} == want
    chain = [(k, k + 1) for k in range(3000)] + [(3000, 2990)]
    began = time.time()
    got = condense.strong_components(spark.createDataFrame(chain, "src long, dst long")).collect()
    assert {r.node for r in got} == set(range(2990, 3001)) and {r.component for r in got} == {2990}
    assert time.time() - began < 120
    assert condense.strong_components(spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string")).count() == 0


def test_representatives():
    """For every set of that many elements: a chosen set avoids it if one of the family does."""
    rng = random.Random(5)
    for _ in range(40):
        size, more = rng.randrange(1, 5), rng.randrange(0, 4)
        family = [rng.sample(range(100, 110), size) for _ in range(60)]
        chosen = condense.representatives(family, more)
        assert len(chosen) <= sum(size**k for k in range(more + 1)) and all(c in family for c in chosen)
        for _ in range(300):
            y = set(rng.sample(range(100, 110), more))
            assert any(not y & set(f) for f in family) == any(not y & set(c) for c in chosen)


def test_a_full_core(spark):
    """Six nodes that all call each other, and themselves: every set of used edges would be a state."""
    edges = [(f"n{a}", f"n{b}") for a in range(6) for b in range(6) if a != b] + [("n0", "n0"), ("n5", "out"), ("in", "n0"), ("out", "far"), ("far", "far")]
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {(r.start, r.node, r.depth) for r in traverse.trails(e, spark.createDataFrame([("in",)], "start string"), 8).collect()}
    assert got == _walks(edges, ["in"], 8)


def test_a_dense_core_among_many_nodes(spark):
    """A core of 20 nodes with four calls each, which 100,000 nodes without cycles call and are called by: 10 levels in bounded time."""
    rng = random.Random(6)
    core = [(f"c{a}", f"c{b}") for a in range(20) for b in rng.sample([x for x in range(20) if x != a], 4)]
    below = [(f"c{k % 20}", f"d{k}") for k in range(500)] + [(f"d{k % 500 if k < 5000 else k - 4500}", f"d{k}") for k in range(500, 50_000)]
    above = [(f"u{k}", f"c{k % 20}" if k < 100 else f"u{k % 100 if k < 1000 else k - 900}") for k in range(50_000)]
    e = spark.createDataFrame(core + below + above, "src string, dst string")
    began = time.time()
    rows = traverse.forward(e, spark.createDataFrame([("u0",), ("c3",)], "start string"), 10).collect()
    assert {(r.node, r.depth) for r in rows if r.start == "c3" and r.node[0] == "c"} >= {(f"c{k}", d) for k in range(20) for d in range(4, 11)}
    callers = traverse.reverse(e, spark.createDataFrame([("d7",)], "target string"), 10).collect()
    assert {r.depth for r in callers} == set(range(1, 11)) and len({r.caller for r in callers}) > 5000
    assert time.time() - began < 240


def test_cycles_against_a_walk(spark):
    rng = random.Random(8)
    for _ in range(3):
        edges = sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(15)})
        steps, want = {}, set()
        for a, b in edges:
            if a != b:
                steps.setdefault(a, []).append(b)

        def go(path, used):
            for b in steps.get(path[-1], ()):
                if (path[-1], b) not in used and len(used) < 7:
                    if b == path[0] and len(used) >= 1:
                        want.add((len(used) + 1, ">".join([*path, b])))
                    go([*path, b], used | {(path[-1], b)})

        for a in steps:
            go([a], frozenset())
        e = spark.createDataFrame(edges, "src string, dst string")
        assert [(r.length, r.path) for r in traverse.cycles(e, 7, limit=None).orderBy("length", "path").collect()] == sorted(want)
        assert [(r.length, r.path) for r in traverse.cycles(e, 7, limit=5).collect()] == sorted(want)[:5]
        from_n1 = traverse.cycles(e, 7, limit=None, starts=spark.createDataFrame([("n1",)], "start string")).collect()
        assert sorted((r.length, r.path) for r in from_n1) == sorted(x for x in want if x[1].startswith("n1>"))


def test_cycles_stop_where_the_limit_is_filled(spark):
    """All of 30 nodes call each other: cycles of 10 edges could never be listed."""
    e = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a in range(30) for b in range(30) if a != b], "src string, dst string")
    assert [r.path for r in traverse.cycles(e, 10).collect()][:2] == ["n00>n01>n00", "n00>n02>n00"]


def test_sequences_visit_depth_first(spark):
    """Against a recursive walk, on graphs where a method is reached late at a lesser depth."""
    rng = random.Random(9)
    for limit in (3, 5):
        calls = [(f"m{rng.randrange(8)}", f"m{rng.randrange(8)}", rng.randrange(1, 9)) for _ in range(22)]
        runs = [(f"m{k}", f"q{k}") for k in range(8)]
        steps, want = {}, []
        for a, b, n in sorted(set(calls), key=lambda c: (c[2], c[1])):
            steps.setdefault(a, []).append(b)

        def walk(top, node, depth, visited, told):
            for b in steps.get(node, ()):
                want.append((top, "call", node, b, depth + 1))
                if depth + 1 < limit and not visited.get(b, 99) <= depth + 1:
                    visited[b] = depth + 1
                    walk(top, b, depth + 1, visited, told)
            for m, q in runs:
                if m == node and node not in told:
                    told.add(node)
                    want.append((top, "sql", node, q, depth + 1))

        for top in ("m0", "m1"):
            walk(top, top, 0, {}, set())
        frame = lambda rows, kind: spark.createDataFrame(rows, kind)
        got = traverse.sequence_events(frame(calls, "src string, dst string, call_order int"), frame(runs, "method string, sql_id string"), frame([("q0", "t")], "sql_id string, table_name string"), frame([("m0",), ("m1",)], "top string"), limit)
        rows = [(r.top, r.kind, r.source, r.target, r.depth) for r in got.orderBy("top", "sort_path").collect() if r.kind != "table"]
        assert sorted(rows) == sorted(want)
        assert [r for r in rows if r[1] == "call"] == [r for r in want if r[1] == "call"]
