"""Change impact: who is affected if a table or a method changes, how far away, and at what risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize
from .traverse import reverse


def risk_points(complexity: Column, depth: Column, n_rows: Column, sql_type: Column) -> Column:
    score = F.coalesce(complexity, F.lit(0))
    points = F.when(score > 10, 30).when(score > 5, 20).when(score > 0, 10).otherwise(0)
    points += F.when(depth >= 5, 20).when(depth >= 3, 15).when(depth >= 1, 10).otherwise(0)
    points += F.when(n_rows > 50, 40).when(n_rows > 20, 30).when(n_rows > 10, 20).otherwise(10)
    return points + F.when(sql_type.isin("UPDATE", "DELETE"), 10).when(sql_type == "INSERT", 5).otherwise(0)


def risk_grade(points: Column) -> Column:
    return F.when(points >= 70, "HIGH").when(points >= 40, "MEDIUM").otherwise("LOW")


def _graded(rows: DataFrame) -> DataFrame:
    """Risk by the number of rows before any are merged, then one row per level and method: the first by class, method and statement."""
    rows = materialize(rows)  # counted, then read again
    n = rows.agg(F.count("*").alias("n_rows"))  # one row
    rows = rows.crossJoin(F.broadcast(n)).withColumn("risk", risk_grade(risk_points(F.col("complexity_score"), F.col("depth"), F.col("n_rows"), F.col("sql_type"))))
    w = Window.partitionBy("depth", "caller").orderBy("caller", "sql_id")
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").select("depth", "caller", "package_name", "class_name", "method", "sql_id", "sql_type", "complexity_score", "risk")


def table_impact(table: str, statements: DataFrame, uses: DataFrame, links: DataFrame, edges: DataFrame, methods: DataFrame, max_depth: int = 10, mode: str = "trail") -> DataFrame:
    """Methods that reach statements on the table, with depth (0: the mapper method itself) and risk.

    statements (project, mapper_name, id, sql_type, complexity_score); uses (project, mapper_name, sql_id, table_name); links (project, mapper_name, sql_id, method) with method as
    the edges name it; edges (src, dst); methods (node, package_name, class_name, method).
    """
    key = ["project", "mapper_name", "sql_id"]
    hit = uses.filter(F.lower("table_name") == table.lower()).select(*key).distinct()
    facts = statements.select("project", "mapper_name", F.col("id").alias("sql_id"), "sql_type", "complexity_score")
    own = hit.join(facts, key).join(links, key).select("sql_id", "sql_type", "complexity_score", F.col("method").alias("target"))
    callers = reverse(edges, own.select("target"), max_depth, mode=mode)
    reached = own.join(callers, "target").unionByName(own.withColumns({"caller": F.col("target"), "depth": F.lit(0)}))
    named = methods.select(F.col("node").alias("caller"), "package_name", "class_name", "method")
    return _graded(reached.join(named, "caller"))


def method_impact(targets: DataFrame, edges: DataFrame, methods: DataFrame, max_depth: int = 10, mode: str = "trail") -> DataFrame:
    """Methods that reach the target methods (column target), depth 1 and up."""
    rows = reverse(edges, targets, max_depth, mode=mode)
    named = methods.select(F.col("node").alias("caller"), "package_name", "class_name", "method")
    facts = {"sql_id": F.lit(None).cast("string"), "sql_type": F.lit(None).cast("string"), "complexity_score": F.lit(0)}
    return _graded(rows.join(named, "caller").withColumns(facts))


def _risks() -> list[Column]:
    return [F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("HIGH", "MEDIUM", "LOW")]


def summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_distinct("class_name").alias("classes"), F.count_distinct("class_name", "method").alias("methods"), F.count_distinct("package_name").alias("packages"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 2).alias("avg_depth"), *_risks())


def package_summary(nodes: DataFrame) -> DataFrame:
    package = F.coalesce(F.nullif("package_name", F.lit("")), F.lit("default")).alias("package")
    return nodes.groupBy(package).agg(F.count_distinct("class_name").alias("classes"), F.count_distinct("class_name", "method").alias("methods"), F.round(F.avg("depth"), 2).alias("avg_depth"), *_risks())


def sql_details(nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """(sql_id, mapper_name, sql_type, complexity_score, preview) of the impacted statements; the first mapper by name where an id recurs."""
    w = Window.partitionBy("sql_id").orderBy("mapper_name")
    rows = nodes.select("sql_id").filter("sql_id is not null").distinct().join(statements.withColumnRenamed("id", "sql_id"), "sql_id")
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").select("sql_id", "mapper_name", "sql_type", "complexity_score", F.substring("sql_content", 1, 100).alias("preview"))
