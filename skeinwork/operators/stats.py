"""Statistics over statements, tables, mappers and the whole graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import complexity_bucket


def sql_statistics(statements: DataFrame) -> DataFrame:
    """One row: counts, types and the distribution of the complexity score; nulls are skipped."""
    score = F.col("complexity_score")
    return statements.agg(
        F.count("*").alias("total_sql"), F.count_distinct("mapper_name").alias("mappers"), F.count_distinct("sql_type").alias("sql_types"),
        F.array_join(F.sort_array(F.collect_set("sql_type")), ",").alias("types"), F.round(F.avg(score), 4).alias("avg_complexity"),
        F.percentile(score, F.lit(0.5)).alias("median_complexity"), F.max(score).alias("max_complexity"), F.min(score).alias("min_complexity"),
    )


def table_usage(uses: DataFrame, statements: DataFrame) -> DataFrame:
    """(table_name, access_count, operations): statements per table and their types, most used first."""
    key = ["project", "mapper_name", "sql_id"]
    kinds = statements.select("project", "mapper_name", F.col("id").alias("sql_id"), "sql_type")
    rows = uses.select(*key, "table_name").distinct().join(kinds, key)
    return rows.groupBy("table_name").agg(F.count("*").alias("access_count"), F.array_join(F.sort_array(F.collect_set("sql_type")), ",").alias("operations"))


def complexity_histogram(statements: DataFrame) -> DataFrame:
    return statements.groupBy(complexity_bucket(F.col("complexity_score")).alias("level")).agg(F.count("*").alias("n"))


def mapper_distribution(statements: DataFrame) -> DataFrame:
    return statements.groupBy("mapper_name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("sql_type")), ",").alias("types"))


def graph_statistics(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, n): rows per node label and edge type, and a total of each kind."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n") for kind, group in (("node", nodes), ("edge", edges)) for name, df in group.items()]
    each = reduce(DataFrame.unionByName, parts)
    totals = each.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("total").alias("name"), "n")
    return each.unionByName(totals)


def counts_by_type(statements: DataFrame) -> DataFrame:
    """One row of counts per SQL type in columns."""
    kinds = ("SELECT", "INSERT", "UPDATE", "DELETE")
    other = F.count_if(~F.coalesce(F.col("sql_type").isin(*kinds), F.lit(False)))
    return statements.agg(F.count("*").alias("total"), *[F.count_if(F.col("sql_type") == k).alias(k.lower() + "_count") for k in kinds], other.alias("other_count"))


def call_chain_summary(chain: DataFrame) -> DataFrame:
    """(class_name, rows, methods, statements, tables) of call-chain rows per class."""
    return chain.groupBy("class_name").agg(F.count("*").alias("n_rows"), F.count_distinct("method").alias("n_methods"), F.count_distinct("sql_id").alias("n_sql"), F.count_distinct("table_name").alias("n_tables"))


def table_impact(accesses_: DataFrame, scores: DataFrame, table: str, high: int = 7) -> DataFrame:
    """One row about a table: distinct classes, methods and statements that use it, their operations, and the complex ones."""
    key = ["project", "mapper_name", "sql_id"]
    rows = accesses_.filter(F.col("table_name") == table).join(scores.select("project", "mapper_name", F.col("id").alias("sql_id"), "complexity_score"), key)
    hard = F.collect_set(F.when(F.col("complexity_score") > high, F.col("sql_id")))
    return rows.agg(
        F.count_distinct("class_name").alias("classes"), F.count_distinct("class_name", "method").alias("methods"), F.count_distinct(*key).alias("statements"),
        F.array_join(F.sort_array(F.collect_set("op")), "").alias("ops"), F.size(hard).alias("n_complex"),
    )


def package_contents(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(package_name, classes, n_methods, n_fields); each side is counted before they meet, so neither multiplies the other."""
    m = methods.groupBy("package_name").agg(F.array_join(F.sort_array(F.collect_set("class_name")), ",").alias("classes"), F.count_distinct("class_name", "name").alias("n_methods"))
    f = fields.groupBy("package_name").agg(F.count_distinct("class_name", "name").alias("n_fields"))
    return m.join(f, "package_name", "left").fillna({"n_fields": 0})


def test_scope(tests: DataFrame, methods: DataFrame) -> DataFrame:
    """(test_class, n_methods) of every test class, zero without methods."""
    n = methods.groupBy(F.col("class_name").alias("test_class")).agg(F.count("*").alias("n_methods"))
    return tests.select(F.col("name").alias("test_class")).join(n, "test_class", "left").fillna({"n_methods": 0})


def accuracy(df: DataFrame, good, by: list[str] | None = None) -> DataFrame:
    """(by…, total, good, percent) of rows for which the condition good holds; null counts as not."""
    ok = F.coalesce(good, F.lit(False))
    agg = [F.count("*").alias("total"), F.count_if(ok).alias("good"), F.round(100 * F.avg(ok.cast("int")), 4).alias("percent")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def access_report(accesses_: DataFrame) -> DataFrame:
    """(section, name, detail, n): types, tables (with access types) and mappers (with tables) in one long table."""
    key = ["project", "mapper_name", "sql_id"]
    types = accesses_.groupBy(F.col("sql_type").alias("name")).agg(F.lit("").alias("detail"), F.count_distinct(*key).alias("n")).select(F.lit("type").alias("section"), "*")
    tables = accesses_.groupBy(F.col("table_name").alias("name")).agg(F.array_join(F.sort_array(F.collect_set("op")), "").alias("detail"), F.count_distinct(*key).alias("n")).select(F.lit("table").alias("section"), "*")
    mappers = accesses_.groupBy(F.col("mapper_name").alias("name")).agg(F.count_distinct("table_name").cast("string").alias("detail"), F.count_distinct(*key).alias("n")).select(F.lit("mapper").alias("section"), "*")
    return types.unionByName(tables).unionByName(mappers)
