"""Run summaries and the ready-made graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import by_key
from .linkage import first_per_key


def run_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) of every table of a run."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_statistics(runs: DataFrame) -> DataFrame:
    """runs (name, started, ended) with duration_ms and its text."""
    from ..functions.names import duration_text

    took = (F.unix_micros("ended") - F.unix_micros("started")) / 1000
    return runs.withColumn("duration_ms", took.cast("long")).withColumn("duration", duration_text(F.col("duration_ms") / 1000))


def class_list(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(package_name, class_name, sub_type, n_methods), by package and name."""
    n = methods.groupBy("project", "class_name").agg(F.count("*").alias("n_methods"))
    rows = classes.withColumnRenamed("name", "class_name").join(n, ["project", "class_name"], "left").fillna({"n_methods": 0})
    return rows.select("package_name", "class_name", "sub_type", "n_methods").orderBy(F.asc_nulls_last("package_name"), "class_name")


def method_list(methods: DataFrame, class_name: str) -> DataFrame:
    rows = methods.filter(F.col("class_name") == class_name)
    args = F.array_join(F.transform("parameters", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    return rows.select("name", "return_type", "visibility", args.alias("arguments"), "logical_name").orderBy("name", "arguments")


def class_details(classes: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(class_name, methods, fields) with each side aggregated before they meet."""
    key = ["project", "class_name"]
    m = methods.groupBy(*key).agg(F.sort_array(F.collect_set("name")).alias("methods"))
    f = fields.groupBy(*key).agg(F.sort_array(F.collect_set("name")).alias("fields"))
    none = F.array().cast("array<string>")
    rows = classes.select("project", F.col("name").alias("class_name")).join(by_key(m), key, "left").join(by_key(f), key, "left")
    return rows.select("class_name", F.coalesce("methods", none).alias("methods"), F.coalesce("fields", none).alias("fields"))


def unused_statements(statements: DataFrame, links: DataFrame) -> DataFrame:
    """Statements that no method runs."""
    return statements.join(links.select("project", "mapper_name", F.col("sql_id").alias("id")), ["project", "mapper_name", "id"], "left_anti")


def latest_run(runs: DataFrame) -> DataFrame:
    return first_per_key(runs, ["name"], [F.desc("started"), F.desc("ended")])
