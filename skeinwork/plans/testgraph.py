"""A code graph laid over the driver's tables, as SQL that Spark and DuckDB read alike.

Orders are SQL statements of mappers, their lines name the tables the statements touch, customers call services, services call
mappers, and nations call each other in circles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import table

_KIND = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'SELECT' WHEN '2' THEN 'INSERT' WHEN '3' THEN 'UPDATE' WHEN '4' THEN 'DELETE' ELSE 'MERGE' END"
_STATEMENT = "concat('P', o_custkey % 3) AS project, concat('M', o_custkey % 40, 'Mapper') AS mapper_name, concat('q', o_orderkey)"
#: name -> query over the driver's tables, whose names stand in braces.
GRAPH = {
    "statements": f"SELECT {_STATEMENT} AS id, {_KIND} AS sql_type, concat('SELECT * FROM t', o_custkey % 97, ' WHERE id = #{{{{id}}}}') AS sql_content, CAST(coalesce(n, 0) AS BIGINT) AS complexity_score "
    "FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) x ON o_orderkey = l_orderkey",
    "uses": f"SELECT DISTINCT {_STATEMENT} AS sql_id, concat('t', l_partkey % 97) AS table_name FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey",
    "runs": f"SELECT {_STATEMENT} AS sql_id, 'app.mapper' AS package_name, concat('M', o_custkey % 40, 'Mapper') AS class_name, concat('q', o_orderkey) AS method, {_KIND} AS sql_type FROM {{orders}}",
    "edges": "SELECT DISTINCT concat('C', c_custkey % 15, 'Controller.h', c_custkey % 10) AS src, concat('S', c_custkey % 25, 'Service.do', c_custkey % 7) AS dst FROM {customer} "
    "UNION SELECT concat('S', o_custkey % 25, 'Service.do', o_custkey % 7) AS src, concat('M', o_custkey % 40, 'Mapper.q', o_orderkey) AS dst FROM {orders} "
    "UNION SELECT concat('S', n_nationkey % 25, 'Service.do', n_nationkey % 7) AS src, concat('S', (n_nationkey * 4 + 1) % 25, 'Service.do', ((n_nationkey * 4 + 1) % 25) % 7) AS dst FROM {nation}",
    "tables": "SELECT DISTINCT concat('t', p_partkey % 97) AS name, CASE WHEN p_partkey % 97 < 60 THEN concat('s', p_partkey % 97 % 4) END AS schema FROM {part}",
}
_READS = ("orders", "lineitem", "customer", "nation", "part")
#: The same as common table expressions for DuckDB.
CTES = "WITH " + ", ".join(f"{name} AS ({sql.format(**{t: t for t in _READS})})" for name, sql in GRAPH.items())
NODE = "SELECT DISTINCT node, split_part(node, '.', 1) AS class_name, split_part(node, '.', 2) AS method, CASE substr(node, 1, 1) WHEN 'M' THEN 'app.mapper' WHEN 'S' THEN 'app.service' ELSE 'app.web' END AS package_name FROM (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges})"
CTES += ", nodes AS (" + NODE.format(edges="edges") + ")"


class TestGraph:
    """The graph's DataFrames over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "nodes":
            return self.spark.sql(NODE, edges=self.edges)
        if name not in GRAPH:
            raise AttributeError(name)
        text = GRAPH[name]
        return self.spark.sql(text, **{t: table(self.spark, self.sf_dir, t) for t in _READS if "{" + t + "}" in text})

    def accesses(self) -> DataFrame:
        from ..operators import crud

        return crud.accesses(self.runs, self.uses)

    def links(self) -> DataFrame:
        """(project, mapper_name, sql_id, method) with methods named as nodes are."""
        from pyspark.sql import functions as F

        return self.runs.select("project", "mapper_name", "sql_id", F.concat_ws(".", "class_name", "method").alias("method"))
