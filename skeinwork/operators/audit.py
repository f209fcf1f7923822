"""Audits of mappings between code and database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import types_match
from ..tables import by_key


def column_mappings(entity_columns: DataFrame, db_columns: DataFrame) -> DataFrame:
    """Entity columns (entity, table_name, property, column_name, java_type, nullable, unique, primary_key) against database columns by lower-case names.

    mapping_quality is good, needs_review or missing; issues says why.
    """
    e = entity_columns.withColumns({"t": F.lower("table_name"), "c": F.lower("column_name")})
    d = db_columns.select(F.lower("table_name").alias("t"), F.lower("name").alias("c"), F.col("name").alias("db_column"), "data_type", F.col("nullable").alias("db_nullable"), F.col("unique").alias("db_unique"), F.col("primary_key").alias("db_primary_key"))
    m = e.join(d, ["t", "c"], "left")
    there = F.col("db_column").isNotNull()

    def same(a: str, b: str) -> Column:
        return there & F.coalesce(F.col(a) == F.col(b), F.lit(False))

    m = m.withColumns({"type_match": there & types_match(F.col("java_type"), F.col("data_type")), "nullable_match": same("nullable", "db_nullable"), "unique_match": same("unique", "db_unique"), "key_match": same("primary_key", "db_primary_key")})
    good = F.col("type_match") & F.col("nullable_match") & F.col("unique_match") & F.col("key_match")
    issues = F.array_compact(F.array(
        F.when(~there, F.concat(F.lit("column missing: "), "column_name")),
        F.when(there & ~F.col("type_match"), F.concat(F.lit("type differs: "), "column_name")),
        F.when(there & ~F.col("nullable_match"), F.concat(F.lit("nullable differs: "), "column_name")),
        F.when(there & ~F.col("unique_match"), F.concat(F.lit("unique differs: "), "column_name")),
    ))
    return m.select("entity", "table_name", "property", "column_name", "db_column", "type_match", "nullable_match", "unique_match", "key_match", F.when(~there, "missing").when(good, "good").otherwise("needs_review").alias("mapping_quality"), issues.alias("issues"))


def entity_tables(entities: DataFrame, tables: DataFrame) -> DataFrame:
    """(entity, table_name, side): both, entity_only or table_only, by lower-case table name."""
    e = entities.select("entity", F.lower("table_name").alias("t"), F.col("table_name").alias("named")).distinct()
    t = tables.select(F.lower("name").alias("t"), F.col("name").alias("db_table")).distinct()
    side = F.when(F.col("entity").isNull(), "table_only").when(F.col("db_table").isNull(), "entity_only").otherwise("both")
    return e.join(t, "t", "full").select("entity", F.coalesce("db_table", "named").alias("table_name"), side.alias("side"))


def accuracy_by_entity(mappings: DataFrame) -> DataFrame:
    good = F.col("mapping_quality") == "good"
    return mappings.groupBy("entity").agg(F.count("*").alias("total"), F.count_if(good).alias("good"), F.round(100 * F.avg(good.cast("int")), 4).alias("percent"))


def relationship_quality(target: Column, kind: Column, mapped_by: Column, join_column: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    issues = none(target).cast("int") + (kind.isin("OneToMany", "ManyToMany") & none(mapped_by)).cast("int") + (kind.isin("OneToOne", "ManyToOne") & none(join_column)).cast("int")
    return F.when(issues == 0, "good").when(issues == 1, "needs_review").otherwise("needs_attention")


def result_maps(maps: DataFrame, statements: DataFrame) -> DataFrame:
    """(mapper_name, result_map, n_properties, n_mapped, completeness, used_by): each result map and the statements that name it.

    maps has mappings as structs (property, column, is_id); a mapping counts if it has both names, ids included.
    """
    used = statements.filter("result_map is not null").groupBy("mapper_name", F.col("result_map").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("used_by"))
    n = F.size("mappings")
    mapped = F.size(F.filter("mappings", lambda m: (F.coalesce(m["property"], F.lit("")) != "") & (F.coalesce(m["column"], F.lit("")) != "")))
    rows = maps.join(by_key(used), ["mapper_name", "id"], "left")
    return rows.select("mapper_name", F.col("id").alias("result_map"), n.alias("n_properties"), mapped.alias("n_mapped"), F.when(n > 0, F.round(100 * mapped / n, 4)).otherwise(0.0).alias("completeness"), F.coalesce("used_by", F.lit("")).alias("used_by"))


def sql_methods(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """Statements with the mapper method of their name (null without one) and its return type and parameter count."""
    m = methods.select("project", F.col("class_name").alias("mapper_name"), F.col("name").alias("id"), F.col("name").alias("method"), "return_type", F.size("parameters").alias("n_parameters"))
    return statements.join(m, ["project", "mapper_name", "id"], "left").select("project", "mapper_name", "id", "sql_type", "method", "return_type", "n_parameters")
