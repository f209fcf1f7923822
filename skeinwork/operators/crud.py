"""CRUD matrices: which class does what to which table.

Inputs: runs (project, package_name, class_name, method, mapper_name, sql_id, sql_type) says which method runs which statement, and
uses (project, mapper_name, sql_id, table_name) which tables a statement touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linkage import with_schema
from .predicates import op_letter, op_name, optional

_STATEMENT = ["project", "mapper_name", "sql_id"]


def accesses(runs: DataFrame, uses: DataFrame, project: str | None = None) -> DataFrame:
    """One row per method, statement and table, with the operation's letter. Where uses says whether a table is written, tables that a change only reads count as read."""
    said = "written" in uses.columns
    rows = optional(runs, project=project).join(uses.select(*_STATEMENT, "table_name", *["written"] * said).distinct(), _STATEMENT)
    if said:
        rows = rows.withColumn("sql_type", F.when(F.col("written"), F.col("sql_type")).otherwise("SELECT")).drop("written")
    return rows.withColumn("op", op_letter(F.col("sql_type")))


def _ops(sep: str = "") -> Column:
    return F.array_join(F.sort_array(F.collect_set("op")), sep)


def matrix(accesses_: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(class_name, package_name, method, table_name, schema, ops): sorted letters per class, method and table."""
    rows = accesses_.groupBy("class_name", "method", "table_name").agg(F.min("package_name").alias("package_name"), _ops().alias("ops"))
    return with_schema(rows, tables) if tables is not None else rows


def counts_by_table(accesses_: DataFrame) -> DataFrame:
    """(table_name, operation, n): statements by table and READ, CREATE, UPDATE, DELETE or OTHER."""
    rows = accesses_.select(*_STATEMENT, "table_name", op_name(F.col("sql_type")).alias("operation")).distinct()
    return rows.groupBy("table_name", "operation").agg(F.count("*").alias("n"))


def by_class(accesses_: DataFrame) -> DataFrame:
    """(class_name, package_name, tables, ops, sql_ids): per class its tables with their letters, all letters and its statements, as text."""
    per_table = accesses_.groupBy("class_name", "package_name", "table_name").agg(_ops().alias("t_ops"))
    tables = per_table.groupBy("class_name", "package_name").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "table_name", "t_ops"))), ",").alias("tables"))
    whole = accesses_.groupBy("class_name", "package_name").agg(_ops().alias("ops"), F.count_distinct("sql_id").alias("n_sql"))
    return tables.join(whole, ["class_name", "package_name"])


def summary(accesses_: DataFrame) -> DataFrame:
    """One row: totals, classes per operation, the class with most operations and the table used most; ties go to the smaller name."""
    classes = accesses_.groupBy("class_name").agg(F.count_distinct("op").alias("n"))
    tables = accesses_.groupBy("table_name").agg(F.count("*").alias("n"))

    def top(df: DataFrame, name: str, as_: str) -> DataFrame:
        first = F.min_by(name, F.struct((-F.col("n")).alias("k"), F.col(name).alias("name")))
        return df.agg(first.alias(as_), F.count("*").alias(f"total_{name.split('_')[0]}"))

    per_op = accesses_.agg(*[F.count_distinct(F.when(F.col("op") == o, F.col("class_name"))).alias(f"classes_{o.lower()}") for o in "CRUD"])
    # three tables of one row each
    return top(classes, "class_name", "most_active_class").crossJoin(top(tables, "table_name", "most_used_table")).crossJoin(per_op)


def crosstab(accesses_: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Classes by tables, a cell holding the letters joined by /, or - without any. A list of tables saves finding the columns."""
    grouped = accesses_.groupBy("class_name")
    wide = (grouped.pivot("table_name", tables) if tables else grouped.pivot("table_name")).agg(_ops("/"))
    cells = [c for c in wide.columns if c != "class_name"]
    return wide.select("class_name", *[F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) == "", "-").otherwise(F.col(f"`{c}`")).alias(c) for c in cells])


def of_class(accesses_: DataFrame, class_name: str, tables: DataFrame | None = None) -> DataFrame:
    """(full_name, ops) of one class: schema.table, public where no schema is known."""
    rows = accesses_.filter(F.col("class_name") == class_name).groupBy("table_name").agg(_ops().alias("ops"))
    rows = with_schema(rows, tables, "public") if tables is not None else rows.withColumn("schema", F.lit("public"))
    return rows.select(F.concat_ws(".", "schema", "table_name").alias("full_name"), "ops")


def table_summary(accesses_: DataFrame) -> DataFrame:
    """(table_name, classes, reads, writes): how many classes, reading and writing statements each table has."""
    rows = accesses_.select("class_name", *_STATEMENT, "table_name", "op").distinct()
    return rows.groupBy("table_name").agg(F.count_distinct("class_name").alias("classes"), F.count_if(F.col("op") == "R").alias("reads"), F.count_if(F.col("op").isin("C", "U", "D")).alias("writes"))


def command_stats(accesses_: DataFrame) -> DataFrame:
    return accesses_.agg(F.count("*").alias("relationships"), F.count_distinct("table_name").alias("tables"))
