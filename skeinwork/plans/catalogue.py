"""The driver's query catalogue: each query applies a library operator to the graph laid over the test tables, and has its own SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import sqlmeta
from ..operators import audit, classspec, crud, impact, linkage, predicates, reach, stats, summary, traverse, upsert
from ..sinks import report
from ..tables import materialize, table
from .testgraph import CTES, TestGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_ACC = CTES + """, acc AS (SELECT r.*, u.table_name, CASE sql_type WHEN 'INSERT' THEN 'C' WHEN 'SELECT' THEN 'R' WHEN 'UPDATE' THEN 'U' WHEN 'DELETE' THEN 'D' ELSE 'O' END AS op
  FROM runs r JOIN uses u USING (project, mapper_name, sql_id))"""
_OPS = "string_agg(DISTINCT op, '' ORDER BY op)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# CRUD


@query(f"""{_ACC} SELECT class_name, method, table_name, min(package_name) AS package_name, {_OPS} AS ops, coalesce(min(t.schema), 'unknown') AS schema
FROM acc LEFT JOIN (SELECT name, min(schema) AS schema FROM tables GROUP BY name) t ON name = table_name GROUP BY class_name, method, table_name""")
def crud_matrix(spark, sf):
    g = TestGraph(spark, sf)
    return crud.matrix(g.accesses(), g.tables)


@query(f"""{_ACC} SELECT table_name, CASE sql_type WHEN 'SELECT' THEN 'READ' WHEN 'INSERT' THEN 'CREATE' WHEN 'UPDATE' THEN 'UPDATE' WHEN 'DELETE' THEN 'DELETE' ELSE 'OTHER' END AS operation, count(*) AS n
FROM (SELECT DISTINCT project, mapper_name, sql_id, table_name, sql_type FROM acc) GROUP BY ALL""")
def crud_counts_by_table(spark, sf):
    return crud.counts_by_table(TestGraph(spark, sf).accesses())


@query(f"""{_ACC}, per AS (SELECT class_name, package_name, table_name, {_OPS} AS t_ops FROM acc GROUP BY ALL),
t AS (SELECT class_name, package_name, string_agg(concat(table_name, ':', t_ops), ',' ORDER BY concat(table_name, ':', t_ops)) AS tables FROM per GROUP BY ALL)
SELECT t.*, ops, n_sql FROM t JOIN (SELECT class_name, package_name, {_OPS} AS ops, count(DISTINCT sql_id) AS n_sql FROM acc GROUP BY ALL) USING (class_name, package_name)""")
def crud_by_class(spark, sf):
    return crud.by_class(TestGraph(spark, sf).accesses())


@query(f"""{_ACC}, c AS (SELECT class_name, count(DISTINCT op) AS n FROM acc GROUP BY 1), t AS (SELECT table_name, count(*) AS n FROM acc GROUP BY 1)
SELECT (SELECT class_name FROM c ORDER BY n DESC, class_name LIMIT 1) AS most_active_class, (SELECT count(*) FROM c) AS total_class,
(SELECT table_name FROM t ORDER BY n DESC, table_name LIMIT 1) AS most_used_table, (SELECT count(*) FROM t) AS total_table,
count(DISTINCT class_name) FILTER (op = 'C') AS classes_c, count(DISTINCT class_name) FILTER (op = 'R') AS classes_r, count(DISTINCT class_name) FILTER (op = 'U') AS classes_u, count(DISTINCT class_name) FILTER (op = 'D') AS classes_d FROM acc""")
def crud_summary(spark, sf):
    return crud.summary(TestGraph(spark, sf).accesses())


_TABLES = [f"t{k}" for k in range(97)]


@query(f"{_ACC} SELECT class_name, " + ", ".join(f"coalesce(string_agg(DISTINCT op, '/' ORDER BY op) FILTER (table_name = '{t}'), '-') AS {t}" for t in _TABLES) + " FROM acc GROUP BY class_name")
def crud_crosstab(spark, sf):
    return crud.crosstab(TestGraph(spark, sf).accesses(), _TABLES)


@query(f"""{_ACC} SELECT concat(coalesce(min(t.schema), 'public'), '.', table_name) AS full_name, {_OPS} AS ops
FROM acc LEFT JOIN (SELECT name, min(schema) AS schema FROM tables GROUP BY name) t ON name = table_name WHERE class_name = 'M7Mapper' GROUP BY table_name""")
def crud_of_class(spark, sf):
    g = TestGraph(spark, sf)
    return crud.of_class(g.accesses(), "M7Mapper", g.tables)


@query(f"""{_ACC} SELECT table_name, count(DISTINCT class_name) AS classes, count(*) FILTER (op = 'R') AS reads, count(*) FILTER (op IN ('C', 'U', 'D')) AS writes
FROM (SELECT DISTINCT class_name, project, mapper_name, sql_id, table_name, op FROM acc) GROUP BY table_name""")
def table_summary(spark, sf):
    return crud.table_summary(TestGraph(spark, sf).accesses())


@query(f"{_ACC} SELECT count(*) AS relationships, count(DISTINCT table_name) AS tables FROM acc")
def crud_command_stats(spark, sf):
    return crud.command_stats(TestGraph(spark, sf).accesses())


# Statistics


@query(f"""{CTES} SELECT count(*) AS total_sql, count(DISTINCT mapper_name) AS mappers, count(DISTINCT sql_type) AS sql_types, string_agg(DISTINCT sql_type, ',' ORDER BY sql_type) AS types,
round(avg(complexity_score), 4) AS avg_complexity, quantile_cont(complexity_score, 0.5) AS median_complexity, max(complexity_score) AS max_complexity, min(complexity_score) AS min_complexity FROM statements""")
def sql_stats(spark, sf):
    return stats.sql_statistics(TestGraph(spark, sf).statements)


@query(f"""{_ACC} SELECT table_name, count(*) AS access_count, string_agg(DISTINCT sql_type, ',' ORDER BY sql_type) AS operations
FROM (SELECT DISTINCT project, mapper_name, sql_id, table_name, sql_type FROM acc) GROUP BY table_name""")
def usage_stats(spark, sf):
    g = TestGraph(spark, sf)
    return stats.table_usage(g.uses, g.statements)


_LEVEL = "CASE WHEN complexity_score <= 3 THEN 'simple' WHEN complexity_score <= 7 THEN 'medium' WHEN complexity_score <= 12 THEN 'complex' ELSE 'very_complex' END"


@query(f"{CTES} SELECT {_LEVEL} AS level, count(*) AS n FROM statements GROUP BY 1")
def complexity_histogram(spark, sf):
    return stats.complexity_histogram(TestGraph(spark, sf).statements)


@query(f"{CTES} SELECT mapper_name, count(*) AS n, string_agg(DISTINCT sql_type, ',' ORDER BY sql_type) AS types FROM statements GROUP BY 1")
def mapper_distribution(spark, sf):
    return stats.mapper_distribution(TestGraph(spark, sf).statements)


@query(f"""{CTES}, e AS (SELECT 'node' AS kind, 'sql_statement' AS name, count(*) AS n FROM statements UNION ALL SELECT 'node', 'method', count(*) FROM nodes UNION ALL SELECT 'node', 'table', count(*) FROM tables
UNION ALL SELECT 'edge', 'calls', count(*) FROM edges UNION ALL SELECT 'edge', 'uses', count(*) FROM uses)
SELECT * FROM e UNION ALL SELECT kind, 'total', CAST(sum(n) AS BIGINT) FROM e GROUP BY kind""")
def graph_stats(spark, sf):
    g = TestGraph(spark, sf)
    return stats.graph_statistics({"sql_statement": g.statements, "method": g.nodes, "table": g.tables}, {"calls": g.edges, "uses": g.uses})


@query(f"""{CTES} SELECT count(*) AS total, count(*) FILTER (sql_type = 'SELECT') AS select_count, count(*) FILTER (sql_type = 'INSERT') AS insert_count, count(*) FILTER (sql_type = 'UPDATE') AS update_count,
count(*) FILTER (sql_type = 'DELETE') AS delete_count, count(*) FILTER (sql_type NOT IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE')) AS other_count FROM statements""")
def conditional_counts(spark, sf):
    return stats.counts_by_type(TestGraph(spark, sf).statements)


@query(f"""{_ACC} SELECT count(DISTINCT class_name) AS classes, count(DISTINCT concat(class_name, '.', method)) AS methods, count(DISTINCT concat(acc.project, acc.mapper_name, sql_id)) AS statements, string_agg(DISTINCT op, '' ORDER BY op) AS ops,
CAST(count(DISTINCT sql_id) FILTER (complexity_score > 4) AS INTEGER) AS n_complex FROM acc JOIN statements s ON s.id = sql_id AND s.project = acc.project AND s.mapper_name = acc.mapper_name WHERE table_name = 't5'""")
def table_impact_direct(spark, sf):
    g = TestGraph(spark, sf)
    return stats.table_impact(g.accesses(), g.statements, "t5", high=4)


@query(f"""{CTES}, f AS (SELECT 'app.mapper' AS package_name, count(DISTINCT concat(mapper_name, '.', table_name)) AS n FROM uses)
SELECT package_name, string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS classes, count(DISTINCT node) AS n_methods, coalesce(any_value(f.n), 0) AS n_fields FROM nodes LEFT JOIN f USING (package_name) GROUP BY package_name""")
def package_contents(spark, sf):
    g = TestGraph(spark, sf)
    fields = g.uses.select(F.lit("app.mapper").alias("package_name"), F.col("mapper_name").alias("class_name"), F.col("table_name").alias("name"))
    return stats.package_contents(g.nodes.withColumnRenamed("method", "name"), fields)


@query(f"""{_ACC} SELECT 'type' AS section, sql_type AS name, '' AS detail, count(DISTINCT concat(project, mapper_name, sql_id)) AS n FROM acc GROUP BY 2
UNION ALL SELECT 'table', table_name, {_OPS}, count(DISTINCT concat(project, mapper_name, sql_id)) FROM acc GROUP BY 2
UNION ALL SELECT 'mapper', mapper_name, CAST(count(DISTINCT table_name) AS VARCHAR), count(DISTINCT concat(project, mapper_name, sql_id)) FROM acc GROUP BY 2""")
def access_report(spark, sf):
    return stats.access_report(TestGraph(spark, sf).accesses())


# Joins and look-ups


@query(f"{CTES} SELECT project, class_name, method, mapper_name, sql_id FROM runs")
def method_sql_links(spark, sf):
    g = TestGraph(spark, sf)
    methods = g.runs.select("project", "class_name", F.col("method").alias("name"))
    return linkage.link_methods_to_sql(methods, g.statements)


@query(f"{CTES} SELECT project, class_name, method, mapper_name, sql_id, CASE project WHEN 'P0' THEN 'edge' ELSE 'fallback' END AS via FROM runs")
def fallback_sql(spark, sf):
    g = TestGraph(spark, sf)
    methods = g.runs.select("project", "class_name", F.col("method").alias("name"))
    linked = linkage.link_methods_to_sql(methods.filter("project = 'P0'"), g.statements)
    return linkage.fallback_sql(methods, linked, g.statements)


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_refs(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    return linkage.missing(customers, table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query(f"{CTES} SELECT project, mapper_name, sql_id, table_name, coalesce(t.schema, 'unknown') AS schema FROM uses LEFT JOIN (SELECT name, min(schema) AS schema FROM tables GROUP BY name) t ON name = table_name")
def schema_lookup(spark, sf):
    g = TestGraph(spark, sf)
    return linkage.with_schema(g.uses, g.tables)


@query("""WITH c AS (SELECT DISTINCT concat('K', c_custkey % 50) AS class_name FROM customer),
t AS (SELECT DISTINCT concat('K', s_suppkey % 30, 'Test') AS name, s_suppkey % 30 AS n FROM supplier UNION SELECT DISTINCT concat('TestK', s_suppkey % 45), 100 + s_suppkey % 45 FROM supplier)
SELECT class_name, coalesce(a.name, b.name) AS test_class, CAST(coalesce(a.n, b.n) AS BIGINT) AS method_count FROM c LEFT JOIN t a ON a.name = concat(class_name, 'Test') LEFT JOIN t b ON b.name = concat('Test', class_name)""")
def candidate_name_join(spark, sf):
    s = table(spark, sf, "supplier")
    tests = s.select(F.expr("concat('K', s_suppkey % 30, 'Test')").alias("name"), F.expr("s_suppkey % 30").alias("method_count"))
    tests = tests.union(s.select(F.expr("concat('TestK', s_suppkey % 45)"), F.expr("100 + s_suppkey % 45"))).distinct()
    return linkage.test_classes_of(table(spark, sf, "customer").select(F.expr("concat('K', c_custkey % 50)").alias("name")), tests)


@query(f"{CTES}, w AS (SELECT DISTINCT concat('app.mapper.', mapper_name) AS wanted, mapper_name AS name FROM runs UNION SELECT DISTINCT mapper_name, mapper_name FROM runs) SELECT wanted, name, package_name FROM w JOIN (SELECT DISTINCT class_name, package_name FROM nodes) ON class_name = name")
def suffix_theta_join(spark, sf):
    g = TestGraph(spark, sf)
    classes = g.nodes.select(F.col("class_name").alias("name"), "package_name").distinct()
    mappers = g.runs.select("mapper_name")
    wanted = mappers.select(F.concat(F.lit("app.mapper."), "mapper_name").alias("wanted")).union(mappers).distinct()
    return linkage.class_by_name(classes, wanted)


@query("""SELECT DISTINCT 'P' AS project, split_part(p_name, ' ', 1) AS source_bean, split_part(p_name, ' ', 2) AS target_bean, 'constructor' AS injection_type, concat('a', split_part(p_name, ' ', 2)) AS member
FROM part WHERE split_part(p_name, ' ', 2) <> '' AND split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)""")
def bean_edges(spark, sf):
    words = table(spark, sf, "part").select(F.split("p_name", " ").alias("w")).filter(F.size("w") >= 2)
    up = F.initcap
    beans = words.select(F.explode("w").alias("name")).distinct().select(F.lit("P").alias("project"), "name", up("name").alias("class_name"))
    none = F.array().cast("array<struct<name:string,parameters:map<string,string>>>")
    methods = words.distinct().select(
        F.lit("P").alias("project"), up(F.col("w")[0]).alias("class_name"), up(F.col("w")[0]).alias("name"), none.alias("annotations"),
        F.array(F.struct(F.lit(1).alias("order"), F.concat(F.lit("a"), F.col("w")[1]).alias("name"), up(F.col("w")[1]).alias("type"))).alias("parameters"),
    )
    fields = methods.select("project", "class_name", "name", F.lit("").alias("type"), "annotations").limit(0)
    return linkage.bean_dependencies(beans, fields, methods)


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS segments
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def optional_match(spark, sf):
    customers = linkage.Branch(table(spark, sf, "customer"), {"n_nationkey": "c_nationkey"}, counts={"customers": "c_custkey"}, lists={"segments": "c_mktsegment"})
    nations = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return linkage.optional_match(nations, [customers]).select("r_name", "n_name", "customers", "segments")


# Traversal and impact. The recursive SQL keeps the edges used in a string.

_WALK = """{ctes}, e AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS id FROM (SELECT DISTINCT src, dst FROM edges)),
p AS (SELECT node AS start, node, 0 AS depth, '|' AS used FROM ({starts}) UNION ALL
SELECT p.start, e.{to}, p.depth + 1, concat(p.used, e.id, '|') FROM p JOIN e ON e.{at} = p.node WHERE p.depth < {depth} AND p.used NOT LIKE concat('%|', e.id, '|%'))"""


def _walk(starts: str, depth: int, back: bool = False) -> str:
    at, to = ("dst", "src") if back else ("src", "dst")
    return _WALK.format(ctes=CTES.replace("WITH ", "WITH RECURSIVE ", 1), starts=starts, depth=depth, at=at, to=to)


@query(_walk("SELECT DISTINCT node FROM nodes WHERE class_name = 'C3Controller'", 5) + " SELECT DISTINCT start, node, depth FROM p")
def forward_paths(spark, sf):
    g = TestGraph(spark, sf)
    return traverse.forward(g.edges, g.nodes.filter("class_name = 'C3Controller'").select(F.col("node").alias("start")), 5)


@query(_walk("SELECT DISTINCT node FROM nodes WHERE class_name = 'M7Mapper'", 10, back=True) + " SELECT DISTINCT start AS target, node AS caller, depth FROM p WHERE depth > 0")
def reverse_callers(spark, sf):
    g = TestGraph(spark, sf)
    return traverse.reverse(g.edges, g.nodes.filter("class_name = 'M7Mapper'").select(F.col("node").alias("target")), 10)


@query("""WITH RECURSIVE e AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS id FROM (SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt <> event_type)),
p AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth, '|' AS used, src AS path FROM e UNION ALL
SELECT p.start, e.dst, p.depth + 1, concat(p.used, e.id, '|'), concat(p.path, '>', e.dst) FROM p JOIN e ON e.src = p.node WHERE p.depth < 4 AND p.used NOT LIKE concat('%|', e.id, '|%'))
SELECT path, depth AS length FROM (SELECT DISTINCT path, depth FROM p WHERE start = node AND depth >= 2) ORDER BY length, path LIMIT 40""")
def cycles(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("dst", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return traverse.cycles(e.select(F.col("event_type").alias("src"), "dst").filter("dst is not null"), 4, limit=40)


_POINTS = """CASE WHEN c > 10 THEN 30 WHEN c > 5 THEN 20 WHEN c > 0 THEN 10 ELSE 0 END + CASE WHEN depth >= 5 THEN 20 WHEN depth >= 3 THEN 15 WHEN depth >= 1 THEN 10 ELSE 0 END
 + CASE WHEN total > 50 THEN 40 WHEN total > 20 THEN 30 WHEN total > 10 THEN 20 ELSE 10 END + CASE WHEN sql_type IN ('UPDATE', 'DELETE') THEN 10 WHEN sql_type = 'INSERT' THEN 5 ELSE 0 END"""
_IMPACT = (
    _walk("SELECT DISTINCT concat(mapper_name, '.', sql_id) AS node FROM uses WHERE table_name = 't5'", 4, back=True)
    + f""", w AS (SELECT DISTINCT start, node, depth FROM p), o AS (SELECT DISTINCT u.sql_id, s.sql_type, s.complexity_score AS c, concat(u.mapper_name, '.', u.sql_id) AS target FROM uses u JOIN statements s ON s.project = u.project AND s.mapper_name = u.mapper_name AND s.id = u.sql_id WHERE table_name = 't5'),
r AS (SELECT w.depth, w.node AS caller, n.package_name, n.class_name, n.method, o.sql_id, o.sql_type, o.c, count(*) OVER () AS total FROM o JOIN w ON w.start = o.target JOIN nodes n ON n.node = w.node),
i AS (SELECT depth, caller, package_name, class_name, method, sql_id, sql_type, c AS complexity_score, CASE WHEN {_POINTS} >= 70 THEN 'HIGH' WHEN {_POINTS} >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM (SELECT *, row_number() OVER (PARTITION BY depth, caller ORDER BY sql_id) AS k FROM r) WHERE k = 1)"""
)


def _impact(spark, sf, **limits):
    g = TestGraph(spark, sf)
    return impact.table_impact("T5", g.statements, g.uses, g.links(), g.edges, g.nodes, **limits)


@query(_IMPACT + " SELECT * FROM i")
def impact_risk(spark, sf):
    return _impact(spark, sf, max_depth=4)


_RISKS = "count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, count(*) FILTER (risk = 'LOW') AS low"


@query(_IMPACT + f" SELECT count(DISTINCT class_name) AS classes, count(DISTINCT caller) AS methods, count(DISTINCT package_name) AS packages, max(depth) AS max_depth, round(avg(depth), 2) AS avg_depth, {_RISKS} FROM i")
def impact_summary(spark, sf):
    return impact.summary(_impact(spark, sf, max_depth=4))


@query(_IMPACT + f" SELECT package_name AS package, count(DISTINCT class_name) AS classes, count(DISTINCT caller) AS methods, round(avg(depth), 2) AS avg_depth, {_RISKS} FROM i GROUP BY 1")
def package_summary(spark, sf):
    return impact.package_summary(_impact(spark, sf, max_depth=4))


@query(_IMPACT + " SELECT sql_id, s.mapper_name, s.sql_type, s.complexity_score, substr(s.sql_content, 1, 100) AS preview FROM (SELECT DISTINCT sql_id FROM i) JOIN statements s ON s.id = sql_id")
def impact_sql_details(spark, sf):
    return impact.sql_details(_impact(spark, sf, max_depth=4), TestGraph(spark, sf).statements)


@query(_walk("SELECT DISTINCT node FROM nodes WHERE class_name = 'S3Service'", 6, back=True) + f""", r AS (SELECT DISTINCT start, node, depth FROM p WHERE depth > 0), t AS (SELECT DISTINCT depth, node, count(*) OVER () AS total FROM r),
j AS (SELECT t.depth, n.node AS caller, n.package_name, n.class_name, n.method, CAST(NULL AS VARCHAR) AS sql_id, CAST(NULL AS VARCHAR) AS sql_type, 0 AS complexity_score, 0 AS c, total FROM t JOIN nodes n USING (node))
SELECT depth, caller, package_name, class_name, method, sql_id, sql_type, complexity_score, CASE WHEN {_POINTS} >= 70 THEN 'HIGH' WHEN {_POINTS} >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM j""")
def method_impact(spark, sf):
    g = TestGraph(spark, sf)
    return impact.method_impact(g.nodes.filter("class_name = 'S3Service'").select(F.col("node").alias("target")), g.edges, g.nodes, 6)


@query(_walk("SELECT DISTINCT node FROM nodes WHERE class_name IN ('C3Controller', 'C4Controller')", 3) + """, x AS (SELECT DISTINCT start, node, depth FROM p)
SELECT split_part(start, '.', 1) AS class_name, count(*) AS n_rows, count(DISTINCT x.start) AS n_methods, count(DISTINCT u.sql_id) AS n_sql, count(DISTINCT u.table_name) AS n_tables
FROM x LEFT JOIN (SELECT DISTINCT concat(mapper_name, '.', sql_id) AS node, sql_id, table_name FROM uses) u USING (node) GROUP BY 1""")
def call_chain_summary(spark, sf):
    return _call_chain_summary(spark, sf, max_depth=3)


def _call_chain_summary(spark, sf, **limits):
    g = TestGraph(spark, sf)
    starts = g.nodes.filter("class_name in ('C3Controller', 'C4Controller')").select(F.col("node").alias("start"))
    reached = traverse.forward(g.edges, starts, **limits)
    sql = g.uses.select(F.concat_ws(".", "mapper_name", "sql_id").alias("node"), "sql_id", "table_name").distinct()
    chain = reached.join(sql, "node", "left").select(F.substring_index("start", ".", 1).alias("class_name"), F.col("start").alias("method"), "sql_id", "table_name")
    return stats.call_chain_summary(chain)


@query()
def sequence_events(spark, sf):
    """What happens when a controller's methods run, in order; the tests hold it against a hand-made graph."""
    g = TestGraph(spark, sf)
    calls = g.edges.withColumn("call_order", F.lit(1))
    runs = g.links().select("method", "sql_id")
    tops = g.nodes.filter("class_name = 'C3Controller'").select(F.col("node").alias("top"))
    return traverse.sequence_events(calls, runs, g.uses, tops, 3, visits="shortest").drop("stack")


# The queries above to the operators' own depths: 10 for impact, 5 for call chains.


def _deeper(name: str, depth: int, full: int) -> str:
    return ORACLE[name].replace(f"p.depth < {depth} ", f"p.depth < {full} ")


@query(_deeper("impact_risk", 4, 10))
def impact_risk_full(spark, sf):
    return _impact(spark, sf)


@query(_deeper("impact_summary", 4, 10))
def impact_summary_full(spark, sf):
    return impact.summary(_impact(spark, sf))


@query(_deeper("package_summary", 4, 10))
def package_summary_full(spark, sf):
    return impact.package_summary(_impact(spark, sf))


@query(_deeper("impact_sql_details", 4, 10))
def impact_sql_details_full(spark, sf):
    return impact.sql_details(_impact(spark, sf), TestGraph(spark, sf).statements)


@query(_deeper("call_chain_summary", 3, 5))
def call_chain_summary_full(spark, sf):
    return _call_chain_summary(spark, sf)


@query(ORACLE["method_impact"].replace("p.depth < 6 ", "p.depth < 10 "))
def method_impact_full(spark, sf):
    g = TestGraph(spark, sf)
    return impact.method_impact(g.nodes.filter("class_name = 'S3Service'").select(F.col("node").alias("target")), g.edges, g.nodes)


@query(_walk("SELECT DISTINCT src AS node FROM edges WHERE src LIKE 'S%'", 10).replace("SELECT node AS start", "SELECT node AS path, node AS start").replace("SELECT p.start", "SELECT concat(p.path, '>', e.dst), p.start").replace("FROM (SELECT DISTINCT src, dst FROM edges)", "FROM (SELECT DISTINCT src, dst FROM edges WHERE src LIKE 'S%' AND dst LIKE 'S%')")
    + " SELECT path, depth AS length FROM (SELECT DISTINCT path, depth FROM p WHERE start = node AND depth >= 2) ORDER BY length, path LIMIT 10")
def cycles_full(spark, sf):
    """The first circles of the call graph to the operator's own depth and limit."""
    return traverse.cycles(TestGraph(spark, sf).edges)


def _walk_in_order(top: str, depth: int) -> str:
    """sequence_events as a depth-first walk tells them, without recursion: one set of CTEs a level, which decides what its calls open."""
    parts = ["c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst DESC) AS n FROM edges)"]
    parts.append(f"o0 AS (SELECT node AS top, node, '' AS sort_path, 0 AS depth FROM nodes WHERE class_name = '{top}'), s0 AS (SELECT * FROM o0 WHERE false)")
    for d in range(1, depth + 1):
        parts.append(f"r{d} AS (SELECT top, concat(sort_path, 'a', lpad(CAST(n AS VARCHAR), 6, '0'), ':', dst, '/') AS sort_path, 'call' AS kind, {d} AS depth, src AS source, dst AS target FROM o{d - 1} JOIN c ON node = src)")
        parts.append(f"f{d} AS (SELECT top, target AS node, min(sort_path) AS sort_path, {d} AS depth FROM r{d} WHERE {d} < {depth} GROUP BY top, target)")
        parts.append(f"o{d} AS (SELECT * FROM f{d} f WHERE NOT EXISTS (SELECT 1 FROM s{d - 1} s WHERE s.top = f.top AND s.node = f.node AND s.sort_path < f.sort_path))")
        parts.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM o{d})")
    calls = " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(1, depth + 1))
    return f"""{CTES}, {", ".join(parts)}, opened AS (SELECT top, node, arg_min(sort_path, concat(sort_path, 'b')) AS sort_path, arg_min(depth, concat(sort_path, 'b')) AS depth FROM (SELECT * FROM o0 UNION ALL SELECT * FROM s{depth}) GROUP BY 1, 2),
calls AS ({calls}), m AS (SELECT DISTINCT concat(class_name, '.', method) AS node, sql_id FROM runs),
q AS (SELECT top, concat(sort_path, 'b', sql_id, '/') AS sort_path, 'sql' AS kind, depth + 1 AS depth, node AS source, sql_id AS target FROM opened JOIN m USING (node)),
t AS (SELECT top, concat(sort_path, 'c', table_name) AS sort_path, 'table' AS kind, depth + 1 AS depth, target AS source, table_name AS target FROM q JOIN (SELECT DISTINCT sql_id, table_name FROM uses) u ON u.sql_id = target)
SELECT * FROM calls UNION ALL SELECT * FROM q UNION ALL SELECT * FROM t"""


@query(_walk_in_order("C4Controller", 5))
def sequence_depth_first(spark, sf):
    """What a controller's methods do, in the order of their calls: a method is opened again where a later call comes at a lesser depth."""
    g = TestGraph(spark, sf)
    calls = g.edges.withColumn("call_order", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dst"))))
    tops = g.nodes.filter("class_name = 'C4Controller'").select(F.col("node").alias("top"))
    return traverse.sequence_events(calls, g.links().select("method", "sql_id"), g.uses, tops).drop("stack")


_CHART = """ SELECT style, top, concat(CASE style WHEN 'mermaid' THEN concat('sequenceDiagram', chr(10)) ELSE concat('@startuml', chr(10)) END,
string_agg(concat(CASE style WHEN 'mermaid' THEN '    ' ELSE '' END, regexp_replace(split_part(source, '.', 1), '[^A-Za-z0-9_]', '_', 'g'), CASE WHEN kind = 'return' THEN '--' ELSE '-' END, CASE style WHEN 'mermaid' THEN '>>' ELSE '>' END,
regexp_replace(split_part(target, '.', 1), '[^A-Za-z0-9_]', '_', 'g'), ': ', CASE kind WHEN 'return' THEN 'return' ELSE split_part(target, '.', -1) END), chr(10) ORDER BY sort_path, step),
CASE style WHEN 'mermaid' THEN '' ELSE concat(chr(10), '@enduml') END) AS text FROM flow, (SELECT unnest(['mermaid', 'plantuml']) AS style) GROUP BY style, top"""


@query(_walk_in_order("C4Controller", 5).rsplit("SELECT * FROM calls UNION ALL", 1)[0].rstrip() + """, shown AS (SELECT *, depth - CASE kind WHEN 'sql' THEN 1 ELSE 0 END AS open, coalesce(lead(depth) OVER (PARTITION BY top ORDER BY sort_path), 1) AS next,
list_prepend(top, regexp_extract_all(sort_path, 'a[0-9]{6}:([^/]*)/', 1)) AS stack FROM (SELECT * FROM calls UNION ALL SELECT * FROM q)),
back AS (SELECT *, unnest(range(1, open - next + 2)) AS step FROM shown),
flow AS (SELECT top, sort_path, 0 AS step, kind, source, target FROM shown UNION ALL SELECT top, sort_path, step, 'return', stack[open - step + 2], stack[open - step + 1] FROM back WHERE open - step + 2 > 1)""" + _CHART)
def sequence_charts(spark, sf):
    """Sequence diagrams in both styles of what each method of a controller does."""
    g = TestGraph(spark, sf)
    calls = g.edges.withColumn("call_order", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dst"))))
    tops = g.nodes.filter("class_name = 'C4Controller'").select(F.col("node").alias("top"))
    events = traverse.sequence_events(calls, g.links().select("method", "sql_id"), g.uses, tops)
    flow = materialize(traverse.activation_flow(events))
    return reduce(DataFrame.unionByName, [report.sequence_text(flow, style).withColumn("style", F.lit(style)) for style in ("mermaid", "plantuml")])


# Upserts, deduplication, order


@query("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark, sf):
    return upsert.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("""WITH h AS (SELECT user_id, min(ts) AS created_at, max(event_id) AS seq FROM events WHERE event_type <> 'purchase' GROUP BY 1), n AS (SELECT user_id, ts AS created_at, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1)
SELECT coalesce(h.user_id, n.user_id) AS user_id, coalesce(h.created_at, n.created_at) AS created_at, coalesce(n.seq, h.seq) AS seq FROM h FULL JOIN n ON h.user_id = n.user_id""")
def upsert_first(spark, sf):
    e = table(spark, sf, "events")
    old = e.filter("event_type <> 'purchase'").groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("event_id").alias("seq"))
    new = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return upsert.upsert(old, new, ["user_id"], ["seq"], first_wins=("created_at",))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_anti(spark, sf):
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    kept = upsert.delete_related({"orders": table(spark, sf, "orders")}, gone, {"orders": {"o_custkey": "c_custkey"}})
    return kept["orders"].select("o_orderkey", "o_custkey")


@query(f"""{CTES}, gone AS (SELECT DISTINCT mapper_name FROM statements WHERE mapper_name LIKE 'M1%')
SELECT 'nodes' AS label, count(*) AS n FROM nodes WHERE NOT EXISTS (SELECT 1 FROM gone WHERE contains(node, mapper_name))
UNION ALL SELECT 'edges', count(*) FROM edges WHERE NOT EXISTS (SELECT 1 FROM gone WHERE contains(src, mapper_name) OR contains(dst, mapper_name))
UNION ALL SELECT 'statements', count(*) FROM statements WHERE mapper_name NOT IN (SELECT mapper_name FROM gone)
UNION ALL SELECT 'uses', count(*) FROM uses WHERE mapper_name NOT IN (SELECT mapper_name FROM gone)
UNION ALL SELECT 'tables', count(*) FROM tables""")
def delete_cascade(spark, sf):
    """All tables of a graph without what is related to some mappers: by equal names, and nodes and edges by names that contain theirs."""
    g = TestGraph(spark, sf)
    gone = g.statements.filter("mapper_name like 'M1%'").select("mapper_name")
    held = {name: getattr(g, name) for name in ("nodes", "edges", "statements", "uses", "tables")}
    equal = {name: {"mapper_name": "mapper_name"} for name in ("statements", "uses")}
    within = {"nodes": {"node": "mapper_name"}, "edges": {"src": "mapper_name", "dst": "mapper_name"}}
    return summary.run_counts(upsert.delete_related(held, gone, equal, within))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5(sqlmeta.collapse_whitespace(F.col("text"))).alias("h"))
    return linkage.first_per_key(d, ["lang", "h"], ["doc_id"]).select("doc_id", "lang")


@query("SELECT user_id AS src_class, event_type AS src_method, event_id AS line_number, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS call_order FROM events WHERE value > 5")
def call_order(spark, sf):
    e = table(spark, sf, "events").filter("value > 5").select(F.col("user_id").alias("src_class"), F.col("event_type").alias("src_method"), F.col("event_id").alias("line_number"), F.lit("").alias("dst_class"), F.lit("").alias("dst_method"))
    return traverse.call_order(e).drop("dst_class", "dst_method")


@query("SELECT o_orderkey, o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 4 END AS visibility_rank FROM orders")
def visibility_order(spark, sf):
    shown = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "public", "2", "protected", "3", "private")]), F.substring("o_orderpriority", 1, 1))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", N.visibility_rank(F.coalesce(shown, F.lit("package"))).alias("visibility_rank"))
    return rows.orderBy(F.asc_nulls_last("visibility_rank"), F.asc_nulls_last("o_orderkey"))


# Scalar functions


@query("""SELECT CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS bucket, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1""")
def json_explode(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "struct<k:int>"))
    return e.groupBy((F.col("p.k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query("SELECT CASE o_orderstatus WHEN 'P' THEN false ELSE true END AS is_external, count(*) AS n FROM orders GROUP BY 1")
def external_filter(spark, sf):
    package = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("javafoo"), F.col("o_orderkey"))).when(F.col("o_orderstatus") == "O", "org.springframework.web").otherwise(F.concat(F.lit("com.own"), F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy(N.is_external(package).alias("is_external")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, concat('orders:o,t', o_orderkey % 9, ':x') AS tables, 'LEFT' AS join_kind, 'id,name' AS columns, concat('p', o_custkey) AS parameters, 7 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS complexity, CASE WHEN o_orderkey % 2 = 0 THEN 'complex' ELSE 'medium' END AS level FROM orders""")
def sql_metadata(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("/* a */ SELECT o.id, x.name FROM shop.orders o LEFT JOIN t"), F.col("o_orderkey") % 9, F.lit(" x ON x.id = o.cust_id -- b\n WHERE o.total > #{p"), F.col("o_custkey"), F.lit("} ORDER BY o.id, x.name"), F.when(F.col("o_orderkey") % 2 == 0, ", o.day").otherwise(""))
    rows = sqlmeta.analyse(o.select("o_orderkey", text.alias("sql_content"), F.lit("SELECT").alias("sql_type")))
    return rows.select(
        "o_orderkey", F.array_join(F.transform("tables", lambda t: F.concat_ws(":", t["name"], t["alias"])), ",").alias("tables"), F.col("joins")[0]["kind"].alias("join_kind"),
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"), F.array_join("parameters", ",").alias("parameters"), F.col("complexity_score").alias("complexity"), F.col("complexity_level").alias("level"),
    )


@query("SELECT p_partkey, concat('SELECT ', p_name, ' FROM ', p_type) AS cleaned FROM part")
def comment_strip(spark, sf):
    text = F.concat(F.lit("/* x\n y */ SELECT   "), "p_name", F.lit(" -- note, '"), "p_brand", F.lit("'\n\tFROM "), "p_type", F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", sqlmeta.clean(text).alias("cleaned"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def regex_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("n_paragraphs"), F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), " ").alias("links"))


@query("""SELECT p_partkey, concat(lower(substr(p_type, 1, 1)), substr(p_type, 2)) AS bean, p_type AS simple, 'app.part' AS package, p_type AS outer_name FROM part""")
def string_naming(spark, sf):
    full = F.concat(F.lit("app.part."), "p_type")
    return table(spark, sf, "part").select("p_partkey", N.bean_name(F.col("p_type")).alias("bean"), N.simple_name(full).alias("simple"), N.package_of(full).alias("package"), N.outer_class(F.concat("p_type", F.lit("$Inner"))).alias("outer_name"))


@query("""SELECT event_type, CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'UPDATE' WHEN 'purchase' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'SELECT' END AS guess,
CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'UPDATE' WHEN 'purchase' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'COUNT' END AS derived,
CASE event_type WHEN 'click' THEN 'controller' WHEN 'view' THEN 'dto' WHEN 'purchase' THEN 'mapper' WHEN 'signup' THEN 'service' ELSE '' END AS sub_type,
CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'jpa' WHEN 'purchase' THEN 'mybatis' WHEN 'signup' THEN 'component' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1""")
def name_rules(spark, sf):
    def pick(*values: str):
        return F.element_at(F.create_map(*[F.lit(x) for pair in zip(("click", "view", "purchase", "signup", "error"), values) for x in pair]), F.col("event_type"))

    method = pick("findAll", "updateRow", "removeRow", "saveRow", "countRows")
    kind = N.sub_type(pick("a.web", "a.dto", "a.mappers", "a.b", "a.b"), pick("X", "Y", "Z", "UserService", "Plain"), F.when(F.col("event_type") == "click", F.array(F.lit("RestController"))).otherwise(F.array().cast("array<string>")))
    rows = table(spark, sf, "events").select("event_type", N.method_name_type(method).alias("guess"), N.derived_operation(method).alias("derived"), kind.alias("sub_type"), N.annotation_category(pick("GetMapping", "MapKey", "Select", "Service", "Foo")).alias("category"))
    return rows.groupBy("event_type", "guess", "derived", "sub_type", "category").agg(F.count("*").alias("n"))


@query("SELECT event_id, printf('%02d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) AS duration, strftime(ts, '%Y/%m/%d %H:%M:%S.%g') AS stamp, replace(props, '\"', '_') AS id, concat('a\\|', event_type) AS cell FROM events")
def text_functions(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", N.duration_text(F.col("event_id")).alias("duration"), N.timestamp_text(F.col("ts")).alias("stamp"), F.replace("props", F.lit('"'), F.lit("_")).alias("id"), N.markdown_cell(F.concat(F.lit("a|"), "event_type")).alias("cell"))


# Audits and specifications


def _mappings(spark, sf):
    p = table(spark, sf, "part")
    entity = p.select(F.col("p_brand").alias("entity"), F.upper(F.concat(F.lit("t"), "p_partkey")).alias("table_name"), F.lit("price").alias("property"), F.lit("PRICE").alias("column_name"), F.lit("java.math.BigDecimal").alias("java_type"), (F.col("p_size") > 25).alias("nullable"), F.lit(False).alias("unique"), F.lit(False).alias("primary_key"))
    db = p.filter("p_size <> 7").select(F.concat(F.lit("t"), "p_partkey").alias("table_name"), F.lit("price").alias("name"), F.when(F.col("p_size") % 2 == 0, "DECIMAL(10,2)").otherwise("varchar(9)").alias("data_type"), F.lit(True).alias("nullable"), F.lit(False).alias("unique"), F.lit(False).alias("primary_key"))
    return audit.column_mappings(entity, db)


@query("""SELECT p_brand AS entity, count(*) AS total, count(*) FILTER (p_size <> 7 AND p_size % 2 = 0 AND p_size > 25) AS good, round(100.0 * count(*) FILTER (p_size <> 7 AND p_size % 2 = 0 AND p_size > 25) / count(*), 4) AS percent FROM part GROUP BY 1""")
def mapping_audit(spark, sf):
    return audit.accuracy_by_entity(_mappings(spark, sf))


@query("""SELECT CASE WHEN p_size = 7 THEN 'missing' WHEN p_size % 2 = 0 AND p_size > 25 THEN 'good' ELSE 'needs_review' END AS mapping_quality, CASE WHEN p_size = 7 THEN 1 ELSE CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN p_size > 25 THEN 0 ELSE 1 END END AS n_issues, count(*) AS n FROM part GROUP BY ALL""")
def mapping_issues(spark, sf):
    rows = _mappings(spark, sf).select("mapping_quality", F.size("issues").alias("n_issues"))
    return rows.groupBy("mapping_quality", "n_issues").agg(F.count("*").alias("n"))


@query(f"""{CTES} SELECT project, mapper_name, id, sql_type, CASE WHEN sql_type <> 'MERGE' THEN id END AS method, CASE WHEN sql_type <> 'MERGE' THEN 'List' END AS return_type, CASE WHEN sql_type <> 'MERGE' THEN 1 END AS n_parameters FROM statements""")
def sql_method_report(spark, sf):
    g = TestGraph(spark, sf)
    methods = g.runs.filter("sql_type <> 'MERGE'").select("project", "class_name", F.col("method").alias("name"), F.lit("List").alias("return_type"), F.array(F.lit("id")).alias("parameters"))
    return audit.sql_methods(g.statements, methods)


@query(f"""{CTES} SELECT r.project, class_name, method AS name, concat(sql_id, ':', s.sql_type, ':', complexity_score) AS statements FROM runs r JOIN statements s ON s.project = r.project AND s.mapper_name = r.mapper_name AND s.id = r.sql_id""")
def class_spec_methods(spark, sf):
    g = TestGraph(spark, sf)
    methods = g.runs.select("project", "class_name", F.col("method").alias("name"), F.lit("public").alias("visibility"))
    rows = classspec.method_rows(methods, g.runs.select("project", "class_name", "method", "mapper_name", "sql_id"), g.statements)
    return rows.select("project", "class_name", "name", F.array_join(F.transform("statements", lambda s: F.concat_ws(":", s["sql_id"], s["sql_type"], s["complexity_score"].cast("string"))), ";").alias("statements"))


@query("""SELECT n_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def doc_query_sets(spark, sf):
    customers = linkage.Branch(table(spark, sf, "customer"), {"n_nationkey": "c_nationkey"}, counts={"customers": "c_custkey"}, lists={"segments": "c_mktsegment"})
    suppliers = linkage.Branch(table(spark, sf, "supplier"), {"n_nationkey": "s_nationkey"}, counts={"suppliers": "s_suppkey"})
    return linkage.optional_match(table(spark, sf, "nation"), [customers, suppliers]).select("n_name", "segments", "customers", "suppliers")


@query(f"""{CTES}, l AS (SELECT concat('| ', mapper_name, ' | ', n, ' |') AS line, mapper_name FROM (SELECT mapper_name, count(*) AS n FROM statements GROUP BY 1))
SELECT concat('| mapper_name | n |', chr(10), '|---|---|', chr(10), string_agg(line, chr(10) ORDER BY mapper_name)) AS text FROM l""")
def markdown_report(spark, sf):
    return report.markdown_table(stats.mapper_distribution(TestGraph(spark, sf).statements).drop("types"), ["mapper_name"])


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND value > 10""")
def optional_filters(spark, sf):
    e = table(spark, sf, "events")
    return predicates.optional(e, event_type="click", user_id=None).filter("value > 10").select("event_id", "user_id", "event_type")


# All classes at once. The SQL pairs starts with nodes; the operator does not.

_REACH = """{ctes}, RECURSIVE_r AS (SELECT DISTINCT node AS start, node, 0 AS depth FROM nodes UNION SELECT start, dst, {depth} FROM RECURSIVE_r JOIN edges ON src = node{until}),
u AS (SELECT concat(mapper_name, '.', sql_id) AS node, sql_id, table_name FROM uses),
x AS (SELECT DISTINCT start, node FROM RECURSIVE_r)"""


def _reach(max_depth: int | None) -> str:
    ctes = CTES.replace("WITH ", "WITH RECURSIVE ", 1)
    bounds = ("0", "") if max_depth is None else ("depth + 1", f" WHERE depth < {max_depth}")
    return _REACH.format(ctes=ctes, depth=bounds[0], until=bounds[1]).replace("RECURSIVE_r", "walk")


_PER_CLASS = """ SELECT split_part(start, '.', 1) AS class_name, count(DISTINCT start) AS n_methods, count(DISTINCT sql_id) AS n_sql, count(DISTINCT table_name) AS n_tables FROM x LEFT JOIN u USING (node) GROUP BY 1"""


def _reached_items(g: TestGraph) -> DataFrame:
    node = F.concat_ws(".", "mapper_name", "sql_id").alias("node")
    return g.uses.select(node, F.lit("sql").alias("kind"), F.col("sql_id").alias("item")).unionByName(g.uses.select(node, F.lit("tables").alias("kind"), F.col("table_name").alias("item")))


@query(_reach(5) + _PER_CLASS)
def project_call_chain(spark, sf):
    g = TestGraph(spark, sf)
    return reach.class_summary(g.nodes, g.edges, _reached_items(g), ("sql", "tables"))


@query(_reach(None) + _PER_CLASS)
def project_call_chain_all(spark, sf):
    g = TestGraph(spark, sf)
    return reach.class_summary(g.nodes, g.edges, _reached_items(g), ("sql", "tables"), max_depth=None)


@query(_reach(5) + """ SELECT (SELECT count(DISTINCT class_name) FROM nodes) AS classes, (SELECT count(DISTINCT node) FROM nodes) AS methods, count(DISTINCT sql_id) AS n_sql, count(DISTINCT table_name) AS n_tables,
count(DISTINCT table_name) FILTER (table_name NOT IN (SELECT name FROM tables WHERE schema IS NOT NULL)) AS missing_tables FROM x JOIN u USING (node)""")
def project_call_chain_totals(spark, sf):
    g = TestGraph(spark, sf)
    known = g.tables.filter("schema is not null").select(F.col("name").alias("item"))
    return reach.project_summary(g.nodes, g.edges, _reached_items(g), {"sql": None, "tables": known})
