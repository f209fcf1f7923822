"""Bounded traversal of call graphs.

Edges are (src, dst) names. A path may use an edge once, nodes may recur (trails), and a node is reported at every depth it is
reached at. ``mode="shortest"`` keeps each node's first depth only and so stays linear on dense graphs.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import by_key, materialize
from . import condense


#: Sets of a start and node above which a level's sets are thinned out.
_MANY_SETS = 8


def _thinned(states: DataFrame, more: int) -> DataFrame:
    """states (start, node, sets, ...) with as many of the sets of used edges as trails of ``more`` further edges can need."""
    kind = states.schema

    def of(batches):
        for batch in batches:
            sets = [condense.representatives(x, more) if len(x) > _MANY_SETS else x for x in batch.column("sets").to_pylist()]
            k = batch.schema.get_field_index("sets")
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(sets, batch.schema.field(k).type), *batch.columns[k + 1 :]], schema=batch.schema)

    return states.mapInArrow(of, kind)


def trails(edges: DataFrame, starts: DataFrame, max_depth: int, mode: str = "trail", cut_every: int = 3) -> DataFrame:
    """(start, node, depth) of all trails of 1 to max_depth edges from starts (column start), each once.

    Only edges inside a strongly connected component can recur, and only as long as the trail stays in it. So a start and node hold the sets of edges that
    trails have used since they came into the node's component, none outside of components: there every level is one row per start and
    node, however many ways lead there. Of the sets inside, so many are kept as trails of the edges that are left can tell apart, a number that depends on max_depth alone.
    Each level is one join; every few levels, and those with many sets, are written to the shared folder, so that plans stay short and lost executors redo little.
    """
    steps = edges.select("src", "dst").distinct().withColumn("edge", F.xxhash64("src", "dst"))
    if mode == "trail":
        held = materialize(condense.strong_components(steps))
        x, y = held.select(F.col("node").alias("src"), F.col("component").alias("x")), held.select(F.col("node").alias("dst"), F.col("component").alias("y"))
        again = F.coalesce(F.col("x") == F.col("y"), F.lit(False)) | (F.col("src") == F.col("dst"))
        steps = steps.join(x, "src", "left").join(y, "dst", "left").select("src", "dst", "edge", again.alias("again"))
    else:
        steps = steps.withColumn("again", F.lit(False))
    steps = materialize(steps)
    cyclic = mode == "trail" and not steps.filter("again").isEmpty()
    none = F.array().cast("array<bigint>")
    at = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.array(none).alias("sets"))
    seen = at.select("start", "node")
    levels = []
    for depth in range(1, max_depth + 1):
        if not cyclic:
            at = at.join(steps, at.node == steps.src).select("start", F.col("dst").alias("node"), "sets").dropDuplicates(["start", "node"])
        else:
            one = at.select("start", "node", F.explode("sets").alias("used"))
            nxt = one.join(steps, one.node == steps.src).filter(~F.col("again") | ~F.array_contains("used", F.col("edge")))
            # what leaves a component never comes back to it
            used = F.when(F.col("again"), F.array_sort(F.concat("used", F.array("edge")))).otherwise(none)
            nxt = nxt.select("start", F.col("dst").alias("node"), used.alias("used"))
            sets = F.array(F.any_value("used")) if depth == max_depth else F.collect_set("used")
            at = nxt.groupBy("start", "node").agg(sets.alias("sets"))
        if mode == "shortest":
            at = at.join(seen, ["start", "node"], "left_anti")
        if mode == "shortest" or cyclic or depth % cut_every == 0:
            at = materialize(at)
            if at.isEmpty():
                break
        if cyclic and depth < max_depth and not at.filter(F.size("sets") > _MANY_SETS).isEmpty():
            at = materialize(_thinned(at, max_depth - depth))
        if mode == "shortest":
            seen = seen.union(at.select("start", "node"))
        levels.append(at.select("start", "node", F.lit(depth).alias("depth")))
    if not levels:
        levels = [at.select("start", "node", F.lit(1).alias("depth")).limit(0)]
    return reduce(DataFrame.unionByName, levels)


def forward(edges: DataFrame, starts: DataFrame, max_depth: int = 5, **kw) -> DataFrame:
    """Callees to a depth, the starts themselves at depth 0 included."""
    own = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    return own.unionByName(trails(edges, starts, max_depth, **kw))


def reverse(edges: DataFrame, targets: DataFrame, max_depth: int = 10, **kw) -> DataFrame:
    """(target, caller, depth) of everything that calls the targets (column target) directly or through others."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return trails(back, targets.select(F.col("target").alias("start")), max_depth, **kw).select(F.col("start").alias("target"), F.col("node").alias("caller"), "depth")


def cycles(edges: DataFrame, max_depth: int = 10, limit: int | None = 10, starts: DataFrame | None = None) -> DataFrame:
    """(path, length): trails of 2 to max_depth edges that end where they began, by their node names, from each of their nodes; a limit takes the first by length and path.

    A cycle lies in one strongly connected component. Each is found once, from the least of its edges on, and then told from every node it passes that is in
    starts (column start; all by default). Levels deepen one by one and end with the one that fills the limit, so longer cycles are then never made. Edges from a node to itself are left out.
    """
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    held = materialize(condense.strong_components(e))
    x, y = held.select(F.col("node").alias("src"), F.col("component").alias("x")), held.select(F.col("node").alias("dst"), F.col("component").alias("y"))
    e = materialize(e.join(x, "src").join(y, "dst").filter("x = y").select("src", "dst", F.struct("src", "dst").alias("edge")))
    at = e.select("src", F.col("dst").alias("node"), F.col("edge").alias("least"), F.array("edge").alias("used"))
    found, n = [], 0
    step = e.select(F.col("src").alias("from"), F.col("dst").alias("to"), "edge")
    for length in range(2, max_depth + 1):
        nxt = at.join(step, at.node == step["from"]).filter((F.col("edge") > F.col("least")) & ~F.array_contains("used", F.col("edge")))
        at = materialize(nxt.select("src", F.col("to").alias("node"), "least", F.concat("used", F.array("edge")).alias("used")))
        if at.isEmpty():
            break
        names = F.transform("used", lambda x: x["src"])
        turned = at.filter("node = src").select(names.alias("names")).select("names", F.explode(F.sequence(F.lit(1), F.size("names"))).alias("k"))
        turned = turned.select(F.concat(F.expr("slice(names, k, size(names))"), F.expr("slice(names, 1, k)")).alias("nodes"))
        if starts is not None:
            turned = turned.join(starts.select(F.col("start").alias("first")).distinct(), F.col("nodes")[0] == F.col("first"), "left_semi")
        rows = materialize(turned.select(F.array_join("nodes", ">").alias("path"), F.lit(length).alias("length")).distinct())
        found.append(rows)
        n += rows.count()
        if limit is not None and n >= limit:
            break
    rows = reduce(DataFrame.unionByName, found) if found else e.select(F.col("src").alias("path"), F.lit(0).alias("length")).limit(0)
    return rows.orderBy("length", "path").limit(limit) if limit is not None else rows


def call_order(calls: DataFrame) -> DataFrame:
    """calls with call_order numbered from 1 in each method by position, after whatever filter was applied."""
    w = Window.partitionBy("src_class", "src_method").orderBy("line_number", "dst_class", "dst_method")
    return calls.withColumn("call_order", F.row_number().over(w))


def sequence_events(calls: DataFrame, runs: DataFrame, uses: DataFrame, tops: DataFrame, max_depth: int = 5, visits: str = "depth_first") -> DataFrame:
    """(top, sort_path, kind, depth, source, target, stack) in order of sort_path: what happens when a top method runs.

    calls: (src, dst, call_order); runs: (method, sql_id); uses: (sql_id, table_name); tops: (top). A call comes before what it calls,
    a method's statements after its calls, a statement's tables after it. A call at max_depth is told, but not opened; max_depth <= 0 gives nothing.
    A method is opened as a depth-first walk does: at each call unless an earlier one, in order of sort_path, has opened it at that depth or a lesser one; its statements are told where it first ends.
    Whether a call opens depends only on calls at its depth and lesser ones, so levels are decided one after another, whatever order the walk would see them in.
    ``visits="shortest"`` opens every method once, at its least depth.
    """
    pad = lambda c: F.lpad(c.cast("string"), 6, "0")
    base = tops.select("top", F.col("top").alias("node"), F.lit("").alias("sort_path"), F.array("top").alias("stack"), F.lit(0).alias("depth")).distinct()
    if max_depth <= 0:
        base = base.limit(0)
    walk = visits == "depth_first"
    seen = base.select("top", "node", "sort_path").filter(F.lit(not walk))
    open_, opened, events = base, [base], []
    steps = calls.select("src", "dst", F.coalesce("call_order", F.lit(0)).alias("n")).distinct()
    for depth in range(1, max_depth + 1):
        hit = open_.join(by_key(steps), open_.node == steps.src)
        row = hit.select("top", F.concat("sort_path", F.lit("a"), pad(F.col("n")), F.lit(":"), "dst", F.lit("/")).alias("sort_path"), F.lit("call").alias("kind"), F.lit(depth).alias("depth"), F.col("src").alias("source"), F.col("dst").alias("target"), F.concat("stack", F.array("dst")).alias("stack"))
        row = materialize(row)
        if row.isEmpty():
            break
        events.append(row)
        if walk and depth == max_depth:
            break
        first = Window.partitionBy("top", "target").orderBy("sort_path")
        new = row.withColumn("k", F.row_number().over(first)).filter("k = 1")
        before = seen.groupBy("top", F.col("node").alias("target")).agg(F.min("sort_path").alias("earlier"))
        new = new.join(by_key(before), ["top", "target"], "left").filter(F.col("earlier").isNull() | (F.lit(walk) & (F.col("earlier") > F.col("sort_path"))))
        open_ = materialize(new.select("top", F.col("target").alias("node"), "sort_path", "stack", "depth"))
        opened.append(open_)
        seen = seen.unionByName(open_.select("top", "node", "sort_path"))
    made = reduce(DataFrame.unionByName, events) if events else base.select("top", "sort_path", F.lit("call").alias("kind"), "depth", F.col("node").alias("source"), F.col("node").alias("target"), "stack").limit(0)
    opened = reduce(DataFrame.unionByName, opened)
    opened = opened.withColumn("k", F.row_number().over(Window.partitionBy("top", "node").orderBy(F.concat("sort_path", F.lit("b"))))).filter("k = 1").drop("k")
    sql = opened.join(by_key(runs.select(F.col("method").alias("node"), "sql_id").distinct()), "node")
    sql = sql.select("top", F.concat("sort_path", F.lit("b"), "sql_id", F.lit("/")).alias("sort_path"), F.lit("sql").alias("kind"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("source"), F.col("sql_id").alias("target"), "stack")
    tables = sql.join(by_key(uses.select(F.col("sql_id").alias("target"), "table_name").distinct()), "target")
    tables = tables.select("top", F.concat("sort_path", F.lit("c"), "table_name").alias("sort_path"), F.lit("table").alias("kind"), (F.col("depth") + 1).alias("depth"), F.col("target").alias("source"), F.col("table_name").alias("target"), "stack")
    return made.unionByName(sql).unionByName(tables)


def activation_flow(events: DataFrame) -> DataFrame:
    """(top, sort_path, step, kind, source, target): each call followed by the returns that come before the next event.

    A method is active from its call until an event at its depth or above; the stack each event carries tells to whom it returns.
    """
    w = Window.partitionBy("top").orderBy("sort_path")
    shown = events.filter("kind in ('call', 'sql')").withColumn("next", F.coalesce(F.lead("depth").over(w), F.lit(1)))
    own = shown.select("top", "sort_path", F.lit(0).alias("step"), "kind", "source", "target")
    depth = F.when(F.col("kind") == "sql", F.col("depth") - 1).otherwise(F.col("depth"))
    closed = shown.withColumn("open", depth).withColumn("n", F.col("open") - F.col("next") + 1).filter("n > 0")
    ends = closed.select("top", "sort_path", "stack", "open", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("step"))
    at = F.col("open") - F.col("step") + 2
    back = ends.filter(at > 1).select("top", "sort_path", "step", F.lit("return").alias("kind"), F.element_at("stack", at).alias("source"), F.element_at("stack", at - 1).alias("target"))
    return own.unionByName(back)
